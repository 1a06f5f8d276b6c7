"""The job-board API record shape: page envelopes in, flat postings out.

``api_records`` turns flat postings into the nested record of the API
(FIXTURES.md 1.6); ``page_envelopes`` groups records into response pages of
at most ``page_size`` postings (a bounded group); ``scan_page_envelopes``
(S08) explodes pages back into one row per posting; ``flatten_posting`` (C01)
and ``posting_from_api`` (C02) project the nested record to table columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cleaning as CL
from ..functions import derived as D

NAME = T.StructType([T.StructField("titleFa", T.StringType()), T.StructField("titleEn", T.StringType())])
TITLE_EN = T.StructType([T.StructField("titleEn", T.StringType())])
LOCATION = T.StructType([
    T.StructField("province", T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])),
    T.StructField("city", T.StructType([T.StructField("id", T.LongType()), T.StructField("titleEn", T.StringType())])),
])
POSTING = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("itemIndex", T.LongType()),
    T.StructField("salary", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("activationTime", T.StructType([T.StructField("date", T.StringType())])),
    T.StructField("locations", T.ArrayType(LOCATION)),
    T.StructField("workTypes", T.ArrayType(TITLE_EN)),
    T.StructField("jobPostCategories", T.ArrayType(TITLE_EN)),
    T.StructField("jobBoard", NAME),
    T.StructField("company", NAME),
    T.StructField("gender", T.StringType()),
    T.StructField("companyFaName", T.StringType()),
    T.StructField("provinceMatchCity", T.StringType()),
    T.StructField("normalizeSalaryMin", T.DoubleType()),
    T.StructField("normalizeSalaryMax", T.DoubleType()),
    T.StructField("paymentMethod", T.StringType()),
    T.StructField("district", T.StringType()),
    T.StructField("companyTitleFa", T.StringType()),
    T.StructField("jobBoardId", T.StringType()),
    T.StructField("jobBoardTitleEn", T.StringType()),
    T.StructField("companyDetailsSummary", T.StructType([
        T.StructField("id", T.StringType()), T.StructField("url", T.StringType()),
        T.StructField("name", NAME), T.StructField("about", T.StructType([T.StructField("titleFa", T.StringType())]))])),
])
#: A page; each posting stays the JSON text it came as, so no field of it is lost.
TEXTS = T.ArrayType(T.StringType())
ENVELOPE = T.StructType([
    T.StructField("page", T.LongType()),
    T.StructField("data", T.StructType([
        T.StructField("jobPosts", TEXTS), T.StructField("jobs", TEXTS), T.StructField("hasNextPage", T.BooleanType())])),
    T.StructField("jobs", TEXTS),
])


def record_columns() -> list[Column]:
    """The fields of an API record, from the columns of a flat posting."""
    locs = F.when(D.is_json_array("locations"), F.from_json("locations", T.ArrayType(LOCATION)))
    wts = F.when(D.is_json_array("work_types"), F.from_json("work_types", T.ArrayType(TITLE_EN)))
    cats = F.when(D.is_json_array("job_post_categories"), F.from_json("job_post_categories", T.ArrayType(TITLE_EN)))
    act = F.when(F.col("activation_time").isNotNull(),
                 F.struct(F.date_format("activation_time", "yyyy-MM-dd'T'HH:mm:ss").alias("date")))
    return [
        F.col("id"), F.col("title"), F.col("url"), F.col("id").cast("long").alias("itemIndex"),
        F.col("salary"), D.tags_array().alias("tags"), act.alias("activationTime"),
        locs.alias("locations"), wts.alias("workTypes"), cats.alias("jobPostCategories"),
        F.struct(D.job_board_title_fa().alias("titleFa"), D.job_board_title_en().alias("titleEn")).alias("jobBoard"),
        F.struct(F.col("company_name_fa").alias("titleFa"), F.col("company_name_en").alias("titleEn")).alias("company"),
        F.struct(F.col("company_id").alias("id"), F.lit(None).cast("string").alias("url"),
                 F.struct(F.col("company_name_fa").alias("titleFa"), F.col("company_name_en").alias("titleEn")).alias("name"),
                 F.struct(F.lit(None).cast("string").alias("titleFa")).alias("about")).alias("companyDetailsSummary")]


def api_records(postings: DataFrame) -> DataFrame:
    """Flat postings -> nested API records (page number = id // page_size later)."""
    return postings.select(*record_columns())


def page_number(order: Column, record: list[Column], page_size: int) -> Column:
    """The page of a record by its index.  Records without an index are spread
    over many negative pages by a row hash, so no page collects them all."""
    spread = -1 - F.pmod(F.xxhash64(F.to_json(F.struct(*record))), F.lit(1 << 20))
    return F.coalesce(F.floor(order / page_size).cast("long"), spread)


def page_envelopes(records: DataFrame, page_size: int = 50, order: str = "itemIndex") -> DataFrame:
    """Group records into API response pages ``{"data": {"jobPosts": [...], "hasNextPage": b}}``.

    A page holds at most ``page_size`` postings, so the per-page list is
    bounded whatever the data size.
    """
    names = records.columns
    paged = records.withColumn("page", page_number(F.col(order), [F.col(f"`{c}`") for c in names], page_size))
    return _enveloped(paged, names, order, page_size, records.agg(F.max(order)).first()[0])


def dealt_records(postings: DataFrame, page_size: int = 50) -> DataFrame:
    """The ``api_records`` of flat postings with their ``page``, by which the postings are dealt before the records are built."""
    record = record_columns()
    return postings.withColumn("page", page_number(F.col("id").cast("long"), record, page_size)).repartition("page").select("page", *record)


def posting_pages(postings: DataFrame, page_size: int = 50, records: DataFrame | None = None) -> DataFrame:
    """``page_envelopes`` of the postings' ``api_records``, with one shuffle.

    All tasks build records however few files the tables have, and the nested
    records are not shuffled again.  ``records`` are the ``dealt_records`` where they are at hand.
    """
    records = dealt_records(postings, page_size) if records is None else records
    top = postings.agg(F.max(F.col("id").cast("long"))).first()[0]
    return _enveloped(records, [c for c in records.columns if c != "page"], "itemIndex", page_size, top)


def _enveloped(paged: DataFrame, names: list[str], order: str, page_size: int, top: int | None) -> DataFrame:
    """Records with their ``page`` -> response pages; ``top`` is the last index."""
    pages = paged.groupBy("page").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(
        *[F.col(c) for c in names]).alias("p")))).alias("_posts"))
    # The last page by the index alone, so that the records are built once; only without any index by the pages.
    last = pages.select(F.max("page")).scalar() if top is None else F.floor(F.lit(top) / page_size).cast("long")
    return pages.select("page", F.struct(F.transform("_posts", lambda x: x["p"]).alias("jobPosts"),
                                         (F.col("page") < last).alias("hasNextPage")).alias("data"))


def scan_page_envelopes(spark: SparkSession, path: str, schema: T.StructType = ENVELOPE) -> DataFrame:
    """One row per posting from landed API responses (JSON lines files).

    Accepts the ``data.jobPosts``, ``data.jobs`` and top-level ``jobs`` envelopes.
    """
    raw = spark.read.schema(schema).json(path)
    return explode_envelopes(raw)


#: The envelope and, for a line that is no such JSON, its text.
LANDED = T.StructType([*ENVELOPE.fields, T.StructField("_corrupt_record", T.StringType())])


def postings_of_page() -> Column:
    return F.coalesce(F.col("data.jobPosts"), F.col("data.jobs"), F.col("jobs"))


def malformed(raw: DataFrame) -> DataFrame:
    """Rows of a ``LANDED`` frame that are no page: broken JSON, or no list of postings.

    ``record`` is the line's text, or the JSON that could be read of it.
    """
    lost = postings_of_page().isNull() | F.col("_corrupt_record").isNotNull()
    return raw.where(lost).select("page", F.coalesce(F.col("_corrupt_record"), F.to_json(F.struct("page", "data", "jobs"))).alias("record"))


def malformed_pages(spark: SparkSession, path: str) -> DataFrame:
    """The landed lines that ``scan_page_envelopes`` finds no postings in, to count and keep apart."""
    return malformed(spark.read.schema(LANDED).json(path))


#: Columns of an exploded page that are not fields of the posting.
PAGE_COLUMNS = ("page", "position", "has_next", "record")


def explode_envelopes(raw: DataFrame) -> DataFrame:
    """One row per posting: its fields, and ``record``, the whole posting as it came.

    The list stands in a column of its own before it is exploded: a row that kept
    a field of ``data`` would carry the whole page along.
    """
    pages = raw.select(F.col("page"), F.col("data.hasNextPage").alias("has_next"), postings_of_page().alias("_posts"))
    texts = pages.select("page", "has_next", F.posexplode("_posts").alias("position", "record"))
    return texts.withColumn("p", F.from_json("record", POSTING)).select("page", "position", "has_next", "record", "p.*")


def flatten_posting(rec: DataFrame, batch_id: str | None = None, batch_date=None, keep=()) -> DataFrame:
    """Nested API record -> the 30 table columns (text columns stringified,
    nested JSON kept as text, ``raw_data`` = the whole record as it came, with
    the fields that no column holds).  ``keep`` names columns of ``rec`` to add."""
    act = CL.parse_timestamp(F.col("activationTime.date"), CL.DB_TS_SHAPE)
    loc_ids = F.array_join(F.transform(F.filter(F.flatten(F.transform(
        F.col("locations"), lambda l: F.array(l["province"]["id"], l["city"]["id"]))), lambda x: x.isNotNull()),
        lambda x: F.format_string("%03d", x)), ",")
    codes = F.create_map(*[x for k, v in D.TAG_CODES.items() for x in (F.lit(k), F.lit(v))])
    tag_no = F.coalesce(F.nullif(F.array_join(F.array_sort(F.array_distinct(F.transform(
        F.col("tags"), lambda t: F.coalesce(F.try_element_at(codes, t), F.lit(0))))), ","), F.lit("")), F.lit("0"))
    opts = {"ignoreNullFields": "false"}
    raw = F.col("record") if "record" in rec.columns else F.to_json(F.struct(
        *[F.col(f"`{c}`") for c in rec.columns if c not in PAGE_COLUMNS]), opts)
    return rec.select(
        F.col("id").cast("string").alias("id"), F.col("title").cast("string").alias("title"),
        F.col("url").cast("string").alias("url"),
        F.to_json("locations", opts).alias("locations"), F.to_json("workTypes", opts).alias("work_types"),
        F.col("salary"), F.col("gender"), F.to_json("tags", opts).alias("tags"), F.col("itemIndex").alias("item_index"),
        F.to_json("jobPostCategories", opts).alias("job_post_categories"),
        F.col("companyFaName").alias("company_fa_name"), F.col("provinceMatchCity").alias("province_match_city"),
        F.col("normalizeSalaryMin").alias("normalize_salary_min"), F.col("normalizeSalaryMax").alias("normalize_salary_max"),
        F.col("paymentMethod").alias("payment_method"), F.col("district"), F.col("companyTitleFa").alias("company_title_fa"),
        F.col("jobBoardId").alias("job_board_id"), F.col("jobBoardTitleEn").alias("job_board_title_en"),
        act.alias("activation_time"),
        F.col("companyDetailsSummary.id").alias("company_id"),
        F.col("companyDetailsSummary.name.titleFa").alias("company_name_fa"),
        F.col("companyDetailsSummary.name.titleEn").alias("company_name_en"),
        F.col("companyDetailsSummary.about.titleFa").alias("company_about"),
        F.col("companyDetailsSummary.url").alias("company_url"),
        F.coalesce(loc_ids, F.lit("")).alias("location_ids"), tag_no.alias("tag_number"),
        raw.alias("raw_data"),
        F.lit(batch_id).cast("string").alias("batch_id"), F.lit(batch_date).cast("timestamp_ntz").alias("batch_date"), *keep)


def posting_from_api(rec: DataFrame) -> DataFrame:
    """Company from ``company.titleEn/Fa``; only when both are empty,
    from ``companyDetailsSummary.name``; activation from ``activationTime.date``."""
    en, fa = F.coalesce(F.col("company.titleEn"), F.lit("")), F.coalesce(F.col("company.titleFa"), F.lit(""))
    both_empty = (en == "") & (fa == "")
    return rec.select(
        "id", "title",
        F.when(both_empty, F.col("companyDetailsSummary.name.titleEn")).otherwise(F.col("company.titleEn"))
        .alias("company_name_en"),
        F.when(both_empty, F.col("companyDetailsSummary.name.titleFa")).otherwise(F.col("company.titleFa"))
        .alias("company_name_fa"),
        CL.parse_timestamp(F.col("activationTime.date"), CL.DB_TS_SHAPE).alias("activation_time"))
