"""PII (8): keyed, type-consistent surrogates for detected entities.

Detection is one pattern over the whole text: credentials after a keyword,
access key ids, e-mail addresses, telephone numbers, payment cards (with a
valid check digit), IBANs, social security numbers, IPv4 addresses, and the
names that follow a gendered form of address, wherever their parts occur in
the same document.  An entity's surrogate is drawn from SHA-256 of a key, its
type and its normal form, so one entity has one surrogate in every document
(coreference).  It keeps type, length, letter case, digits and separators of
the value, the script and gender of a name, and the check digit of a card.

Surrogates go through a collision check over all entities of the corpus: one
that equals a detected original of its type, or that another entity has, is
drawn anew; from ``WIDEN_AT`` draws on it is longer than the original, so the
draws end.  Texts without an entity are passed on without a shuffle.

Defined results: a null text stays null, an empty one empty; repeated rows get
equal results; an empty table gives no rows; other columns are passed on, and
n_chars, if there, follows the new text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobsift.llm.catalog import register
from jobsift.llm.common import LOWER, UPPER, documents, free_name, let, on_key, stored, text_key

KEY = "surrogate-key"
WIDEN_AT = 4
MAX_DRAWS = 64

#: Forms of address and the gender they tell.
MALE = ["Mr", "Mister", "Herr", "Monsieur", "Señor", "Signor", "господин", "г-н", "κύριος"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Señorita", "Signora", "госпожа", "г-жа", "κυρία"]

_NAME = r"\p{Lu}[\p{L}'’-]*\p{L}"
ADDRESS = rf"(?<!\p{{L}})(?:{'|'.join(MALE + FEMALE)})\.? +{_NAME}(?: {_NAME}){{0,2}}"
_MALE_ADDRESS = rf"^(?:{'|'.join(MALE)})\.? "

_KEYWORD = r"(?i:passwords?|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|secret[_-]?key)"
_ASSIGNED = _KEYWORD + r"[\"']?[ \t]{0,3}[=:]"
_OPENING = _ASSIGNED + r"[ \t]{0,3}[\"']?"
#: Eight characters at least: a quoted value up to its closing quote, another one up to white space or the punctuation before it.
_QUOTED = r"""(?:(?<=")(?:[^"\\\n]|\\[^\n]){8,}+(?=")|(?<=')(?:[^'\\\n]|\\[^\n]){8,}+(?='))"""
_BARE = r"""[^\s"'=][^\s]{6,}[^\s.,;:!?)\]}>"']"""
#: Without a digit, a call or an index is code, and one word after a colon and blank is prose.
_NO_SECRET = r"""(?!\S*[0-9])(?:[\p{L}_$][\p{L}_$.]*+[(\[]|(?<=:[ \t]{1,3})\p{L}[\p{Ll}'’-]*+(?![\p{L}\p{N}@#$%^&*+=/_~|\\]|[.,;:!?]\S))"""
SECRET = rf"(?<![\p{{L}}\p{{N}}]){_OPENING}(?:{_QUOTED}|(?!{_NO_SECRET}){_BARE})"
ACCESS_KEY = r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}"
PHONE = (r"(?<![\p{L}\p{N}.+-])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)"
         r"|(?<![\p{L}\p{N}])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)"
         r"|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d.-])")
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
CARD = r"(?<![\d.])(?:\d{13,19}|\d{4} \d{4} \d{4} \d{4}|\d{4}-\d{4}-\d{4}-\d{4}|3\d{3} \d{6} \d{5}|3\d{3}-\d{6}-\d{5})(?!\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IP = rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)"
ENTITY = "|".join([SECRET, ACCESS_KEY, EMAIL, SSN, PHONE, IBAN, CARD, IP])
#: Every entity has one of these; a cheap look before the pattern.
GATE = rf"[0-9@]|(?:{'|'.join(MALE + FEMALE)})\.? |{_ASSIGNED}"

#: Syllables and endings that made-up names are put together from, by script.
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe ga ge ka ke ki ko la le li lo ma me mi mo na ne ni no ra re ri ro sa se si so ta te ti to va ve vi vo".split(),
    "cyrillic": "ба бе би бо да де ди до ва ве ви во га ка ке ки ко ла ле ли ло ма ме ми мо на не ни но ра ре ри ро са се си со та те ти то".split(),
    "greek": "βα βε βι βο δα δε δι δο γα γε κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο ρα ρε ρι ρο σα σε σι σο τα τε τι το".split(),
}
ENDINGS = {
    ("latin", "given_m"): ["n", "r", "s", "l", "nd", "rt"], ("latin", "given_f"): ["na", "ra", "lia", "sa", "nia", "tta"],
    ("latin", "surname"): ["nt", "rsk", "mel", "ner", "ston", "veld"],
    ("cyrillic", "given_m"): ["н", "р", "с", "л", "й", "м"], ("cyrillic", "given_f"): ["на", "ра", "лия", "са", "ния", "ма"],
    ("cyrillic", "surname"): ["нко", "рук", "вич", "нюк", "дзе", "шин"],
    ("greek", "given_m"): ["ος", "ης", "ας", "ων", "ευς", "ις"], ("greek", "given_f"): ["α", "η", "ια", "ινα", "ω", "εια"],
    ("greek", "surname"): ["ιδης", "ακης", "ου", "ας", "ακος", "ελης"],
}
GREEK_LOWER = "αβγδεζηθικλμνξοπρστυφχψω"
CYRILLIC_LOWER = "абвгдежзийклмнопрстуфхцчшщыэюя"


def chars(text: Column) -> Column:
    return F.when(F.char_length(text) > 0, F.transform(F.sequence(F.lit(1), F.char_length(text)), lambda i: F.substring(text, i, F.lit(1)))).otherwise(
        F.array().cast("array<string>"))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """The Luhn sum modulo 10 of a string of digits: 0 if its check digit is right."""
    each = F.transform(chars(F.reverse(number)), lambda c, i: let(c.cast("int") * (1 + i % 2), lambda d: F.when(d > 9, d - 9).otherwise(d)))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10


def name_parts(text: Column) -> Column:
    """Parts of the names after a form of address: array of (part, kind)."""

    def parts(found: Column) -> Column:
        male = found.rlike(_MALE_ADDRESS)
        names = F.split(F.regexp_replace(found, r"^[^ ]+ +", ""), " ")
        return F.transform(names, lambda n, i: F.struct(n.alias("part"), F.when(i == F.size(names) - 1, "surname").when(male, "given_m").otherwise("given_f").alias("kind")))

    return F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(ADDRESS), F.lit(0)), parts)))


def pattern(parts: Column) -> Column:
    """The document's pattern: entities, and the parts of the names it has."""
    joined = F.array_join(F.transform(parts, lambda p: p["part"]), "|")
    return F.when(F.size(parts) == 0, F.lit(ENTITY)).otherwise(F.concat(F.lit(ENTITY + r"|(?<!\p{L})(?:"), joined, F.lit(r")(?!\p{L})")))


def kind_of(value: Column, parts: Column) -> Column:
    """The type of a found value; null for what only looks like an entity."""
    named = F.get(F.filter(parts, lambda p: p["part"] == value), F.lit(0))["kind"]

    def whole(p: str) -> Column:
        return value.rlike(f"^(?:{p})$")

    card = F.when(luhn(digits(value)) == 0, "card")
    return (F.when(named.isNotNull(), named).when(value.rlike("^" + _OPENING), "secret").when(whole(ACCESS_KEY), "access_key").when(value.contains("@"), "email")
            .when(whole(IP), "ip").when(whole(SSN), "ssn").when(whole(IBAN), "iban").when(whole(CARD), card).otherwise("phone"))


def normal(value: Column, kind: Column) -> Column:
    """What one entity's spellings have in common."""
    return (F.when(kind.isin("card", "phone", "ssn"), digits(value)).when(kind == "secret", F.regexp_replace(value, "^" + _OPENING, ""))
            .when(kind == "iban", F.regexp_replace(value, " ", "")).when(kind.isin("ip", "access_key"), value).otherwise(F.lower(value)))


def draw(kind: Column, norm: Column, attempt: int, key: str) -> Column:
    """The surrogate of a normal form at the given draw."""
    seed = F.concat_ws("|", F.lit(key), kind, F.lit(str(attempt)), norm)
    hexed = F.concat(*[F.sha2(F.concat_ws("|", F.lit(str(i)), seed), 256) for i in range(2)])

    def made(h: Column) -> Column:
        def number(i) -> Column:
            return F.conv(F.substring(h, 1 + 2 * (i % 64), F.lit(2)), 16, 10).cast("int")

        def pick(alphabet: str, i) -> Column:
            return F.substring(F.lit(alphabet), 1 + number(i) % len(alphabet), F.lit(1))

        def like(text: Column, shift: int = 0) -> Column:
            """Each digit becomes a digit, each letter one of its script and case, the rest stays."""
            return F.array_join(F.transform(chars(text), lambda c, i: F.when(c.rlike("[0-9]"), pick("0123456789", i + shift))
                                            .when(c.rlike("[А-я]"), pick(CYRILLIC_LOWER, i + shift)).when(c.rlike("[Α-ω]"), pick(GREEK_LOWER, i + shift))
                                            .when(c.rlike(r"\p{Lu}"), pick(UPPER, i + shift)).when(c.rlike(r"\p{L}"), pick(LOWER, i + shift)).otherwise(c)), "")

        def name(kind_: str) -> Column:
            def by(script: str) -> Column:
                parts = [F.get(F.array(*[F.lit(s) for s in SYLLABLES[script]]), number(F.lit(i)) % len(SYLLABLES[script])) for i in range(3)]
                return F.concat(*parts, F.get(F.array(*[F.lit(s) for s in ENDINGS[script, kind_]]), number(F.lit(3)) % len(ENDINGS[script, kind_])))

            return F.when(norm.rlike(r"\p{IsCyrillic}"), by("cyrillic")).when(norm.rlike(r"\p{IsGreek}"), by("greek")).otherwise(by("latin"))

        length = F.char_length(norm)
        card = F.concat(F.substring(norm, 1, 1), like(F.substring(norm, F.lit(2), length - 2), 1))
        checked = F.concat(card, ((10 - luhn(F.concat(card, F.lit("0")))) % 10).cast("string"))
        hex_like = F.array_join(F.transform(chars(norm), lambda c, i: pick("0123456789abcdef", i)), "")
        email = F.concat(like(F.substring_index(norm, "@", 1)), F.lit("@"), like(F.substring_index(F.substring_index(norm, "@", -1), ".", 1), 31), F.lit(".example.net"))
        return (F.when(kind == "card", checked).when(kind == "email", email)
                .when(kind == "ip", F.concat(F.lit("10"), *[F.concat(F.lit("."), number(F.lit(i)).cast("string")) for i in range(3)]))
                .when(kind == "ssn", F.concat(F.lit("9"), like(F.substring(norm, 2, 8), 1)))
                .when(kind == "phone", F.concat(F.substring(norm, 1, 1), like(F.substring(norm, F.lit(2), length), 1)))
                .when(kind.isin("iban", "access_key"), F.concat(F.substring(norm, F.lit(1), F.when(kind == "iban", 2).otherwise(4)),
                                                                like(F.substring(norm, F.when(kind == "iban", 3).otherwise(5), length), 4)))
                .when((kind == "secret") & norm.rlike("^[0-9a-f]+$"), hex_like).when(kind == "secret", like(norm))
                .when(kind == "surname", name("surname")).when(kind == "given_m", name("given_m")).otherwise(name("given_f")))

    drawn = let(hexed, made)
    return drawn if attempt < WIDEN_AT else F.concat(drawn, F.lit("-"), F.substring(F.sha2(seed, 256), 1, 8 + 2 * (attempt - WIDEN_AT)))


def surrogates(entities: DataFrame, key: str = KEY) -> DataFrame:
    """kind, norm, surrogate for the distinct entities (kind, norm): no two alike, none an original of its kind."""
    spark = entities.sparkSession
    originals = stored(spark, entities.select("kind", "norm").distinct(), "entities")
    taken = originals.select("kind", F.col("norm").alias("surrogate"))
    pending, done = originals, []
    for attempt in range(MAX_DRAWS):
        drawn = pending.withColumn("surrogate", draw(F.col("kind"), F.col("norm"), attempt, key))
        first = drawn.withColumn("first", F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("norm")) == 1)
        used = taken
        for x in done:
            used = used.unionByName(x.select("kind", "surrogate"))
        checked = first.join(used.distinct().withColumn("used", F.lit(True)), ["kind", "surrogate"], "left")
        checked = stored(spark, checked.select("kind", "norm", "surrogate", (F.col("first") & F.col("used").isNull()).alias("ok")), "draws")
        done.append(checked.where("ok").drop("ok"))
        pending = checked.where("not ok").select("kind", "norm")
        if pending.isEmpty():
            break
    else:
        raise RuntimeError(f"{MAX_DRAWS} draws did not give distinct surrogates")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def rendered(value: Column, kind: Column, surrogate: Column) -> Column:
    """The surrogate in the value's format: its separators, letter case and opening keyword."""
    plain = F.regexp_replace(value, "[^0-9A-Za-z]", "")
    place = F.array_join(F.transform(chars(value), lambda c, i: F.when(c.rlike("[0-9A-Za-z]"), F.substring(
        surrogate, F.char_length(F.regexp_replace(F.substring(value, F.lit(1), i + 1), "[^0-9A-Za-z]", "")), F.lit(1))).otherwise(c)), "")
    cased = F.when(value == F.upper(value), F.upper(surrogate)).when(kind == "email", surrogate).otherwise(F.initcap(surrogate))
    spaced = kind.isin("card", "phone", "ssn", "iban") & (F.char_length(plain) == F.char_length(surrogate))
    return (F.when(spaced, place).when(kind == "secret", F.concat(F.regexp_extract(value, "^" + _OPENING, 0), surrogate))
            .when(kind.isin("surname", "given_m", "given_f", "email"), cased).otherwise(surrogate))


def replace_pii(docs: DataFrame, key: str = KEY) -> DataFrame:
    """The input with surrogates in ``text``, and ``pii`` (``pii_`` if the input has one): the replaced values as array of (kind, surrogate), in order."""
    spark, text, name = docs.sparkSession, F.col("text"), free_name(docs.columns, "pii")
    has = F.coalesce(text.rlike(GATE) & (text.rlike(ENTITY) | text.rlike(ADDRESS)), F.lit(False))
    empty = F.array().cast("array<struct<kind:string,surrogate:string>>")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    plain = docs.where(~has).select(*columns, empty.alias(name))
    hits = docs.where(has).select(*columns, *text_key(F.col("doc_id"), text), name_parts(text).alias("_op_parts"))
    hits = hits.withColumn("_op_pattern", pattern(F.col("_op_parts")))
    found = hits.select("_op_id", "_op_h1", "_op_h2", "_op_parts", F.posexplode(F.regexp_extract_all("text", F.col("_op_pattern"), F.lit(0))).alias("pos", "value"))
    typed = found.distinct().withColumn("kind", kind_of(F.col("value"), F.col("_op_parts"))).drop("_op_parts")
    typed = stored(spark, typed.withColumn("norm", normal(F.col("value"), F.col("kind"))), "found")
    drawn = surrogates(typed.where("kind is not null").select("kind", "norm"), key)
    new = F.coalesce(rendered(F.col("value"), F.col("kind"), F.col("surrogate")), F.col("value"))
    by_row = (typed.join(drawn, ["kind", "norm"], "left").groupBy("_op_id", "_op_h1", "_op_h2")
              .agg(F.array_sort(F.collect_list(F.struct("pos", "kind", new.alias("new")))).alias("_op_new")))
    joined = hits.alias("d").join(by_row.alias("f"), on_key("d", "f"), "left")
    pieces = F.split(F.col("d.text"), F.col("d._op_pattern"), -1)
    put = let(F.coalesce(F.col("f._op_new"), F.array().cast("array<struct<pos:int,kind:string,new:string>>")), lambda n: F.array_join(
        F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(n, i)["new"], F.lit("")))), ""))
    replaced = F.transform(F.filter("f._op_new", lambda x: x["kind"].isNotNull()), lambda x: F.struct(x["kind"].alias("kind"), x["new"].alias("surrogate")))
    changed = joined.select(*[(put.alias("text") if c == "text" else F.col(f"d.`{c}`")) for c in docs.columns], F.coalesce(replaced, empty).alias(name))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.char_length("text").cast("long"))
    return plain.unionByName(changed)


@register("op8_pii_surrogates")
def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = replace_pii(documents(spark, sf_dir))
    return done.select("doc_id", "text", F.size("pii").cast("long").alias("n_replaced"),
                       F.array_join(F.array_sort(F.array_distinct(F.transform("pii", lambda x: x["kind"]))), ",").alias("kinds"))
