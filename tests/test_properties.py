"""Property tests: column rules against small Python models of their stated
semantics, on generated inputs (one Spark job per property)."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from jobsift.functions import cleaning as CL
from jobsift.functions import derived as D

SETTINGS = settings(max_examples=60, deadline=None)
TEXT = st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=40)


def _run(spark, values, col_fn, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(col_fn("v")).collect()]


def model_fix_url(u):
    if u is None or u.startswith(("http://", "https://")):
        return u
    return "https:" + u if u.startswith("//") else "https://" + u


def model_truncate(s, length=150, end="...", leeway=5):
    if s is None or len(s) <= length + leeway:
        return s
    head = s[:length - len(end)]
    return (head.rsplit(" ", 1)[0] if " " in head else head) + end


def model_tag_number(tags):
    if not isinstance(tags, list):
        return "0"
    codes = sorted({D.TAG_CODES.get(t, 0) for t in tags})
    return ",".join(str(c) for c in codes) if codes else "0"


def model_location_ids(locs):
    if not isinstance(locs, list):
        return ""
    ids = []
    for loc in locs:
        if isinstance(loc, dict):
            for part in ("province", "city"):
                obj = loc.get(part)
                if isinstance(obj, dict) and obj.get("id") is not None:
                    ids.append(obj["id"])
    return ",".join(f"{i:03d}" for i in ids)


@SETTINGS
@given(st.lists(st.one_of(st.none(), TEXT, TEXT.map(lambda s: "//" + s), TEXT.map(lambda s: "http://" + s)),
                min_size=1, max_size=30))
def test_fix_url_matches_model(spark, urls):
    assert _run(spark, urls, CL.fix_url) == [model_fix_url(u) for u in urls]


@SETTINGS
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab c", max_size=200)), min_size=1, max_size=20))
def test_truncate_matches_model(spark, texts):
    assert _run(spark, texts, lambda c: D.truncate_words(c, 150)) == [model_truncate(t) for t in texts]


TAG = st.sampled_from(list(D.TAG_CODES) + list(D.TAG_FLAGS.values()) + ["x", "y"])


@SETTINGS
@given(st.lists(st.one_of(st.none(), st.lists(st.one_of(TAG, st.none()), max_size=5), st.just({"a": 1})),
                min_size=1, max_size=20))
def test_tag_number_matches_model(spark, tag_lists):
    texts = [None if t is None else json.dumps(t, ensure_ascii=False) for t in tag_lists]
    assert _run(spark, texts, D.tag_number) == [model_tag_number(t) for t in tag_lists]


ID = st.integers(min_value=0, max_value=99999)
LOC = st.fixed_dictionaries({}, optional={"province": st.fixed_dictionaries({"id": ID}),
                                          "city": st.fixed_dictionaries({"id": ID})})


@SETTINGS
@given(st.lists(st.one_of(st.none(), st.lists(LOC, max_size=4), st.just({"bad": 1})), min_size=1, max_size=20))
def test_location_ids_match_model(spark, loc_lists):
    texts = [None if t is None else json.dumps(t) for t in loc_lists]
    assert _run(spark, texts, D.location_ids) == [model_location_ids(t) for t in loc_lists]


@SETTINGS
@given(st.lists(st.one_of(st.none(), TEXT, st.lists(st.integers(), max_size=3).map(json.dumps),
                          st.dictionaries(st.text(max_size=3), st.integers(), max_size=2).map(json.dumps)),
                min_size=1, max_size=20))
def test_normalize_locations_matches_model(spark, values):
    def model(v):
        if v is None:
            return "[]"
        try:
            json.loads(v)
            return v
        except ValueError:
            return None  # compared by parsing below

    got = _run(spark, values, CL.normalize_locations)
    for v, g in zip(values, got):
        m = model(v)
        if m is None:
            assert json.loads(g) == [v]
        else:
            assert g == m
