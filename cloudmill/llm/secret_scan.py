"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudmill.llm.common import saved, table

KINDS = ("assign", "access", "hex", "owned")  # the order in which equal starts are listed
_WORD = "password|passwd|secret|token|api_?key"
_ASSIGN = rf"(?i:{_WORD})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
# A match that is long enough is the same with the length in the pattern: these are whole runs.
_ACCESS = "AKIA[A-Z0-9]{12,}"
_HEX = "[0-9a-f]{32,}"
# Letters and digits mixed: may be a credential, if the corpus says that one owner has it.
_MIXED = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}"
_SPAN = "struct<start:int,kind:int,end:int,value:string>"


def _found(text: Column, pattern: str, group: int, kind: str) -> Column:
    """All leftmost non-overlapping matches: their places in code points, and a group's text."""
    gaps = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    step = F.transform(
        F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), value.alias("value")),
        lambda x: F.struct(
            F.length(x["gap"]).alias("gap"), F.length(x["whole"]).alias("size"), x["value"].alias("value")
        ),
    )
    start = F.struct(
        F.lit(0).alias("at"), F.expr(f"cast(array() as array<{_SPAN}>)").alias("spans")
    )

    def add(state: Column, x: Column) -> Column:
        begin = state["at"] + x["gap"]
        end = begin + F.coalesce(x["size"], F.lit(0))
        span = F.struct(
            begin.alias("start"),
            F.lit(KINDS.index(kind)).alias("kind"),
            end.alias("end"),
            x["value"].alias("value"),
        )
        spans = F.when(x["value"].isNull(), state["spans"]).otherwise(
            F.concat(state["spans"], F.array(span))
        )
        return F.struct(end.alias("at"), spans.alias("spans"))

    return F.aggregate(step, start, add, lambda state: state["spans"])


def _when(condition: Column, spans: Column) -> Column:
    return F.when(condition, spans).otherwise(F.expr(f"cast(array() as array<{_SPAN}>)"))


def base_spans(text: Column) -> Column:
    """Spans of the kinds assign, access and hex."""
    assign = F.filter(_found(text, _ASSIGN, 1, "assign"), lambda s: F.length(s["value"]) >= 8)
    return F.concat(
        _when(text.rlike(f"(?i:{_WORD})[\"']?\\x20*[:=]"), assign),
        _when(F.contains(text, F.lit("AKIA")), _found(text, _ACCESS, 0, "access")),
        _when(text.rlike(_HEX), _found(text, _HEX, 0, "hex")),
    )


def _listed(spans: Column) -> Column:
    """``kind:start:end`` of spans in order, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    parts = F.transform(
        F.array_sort(spans),
        lambda s: F.concat_ws(
            ":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")
        ),
    )
    return F.array_join(parts, ",")


def scan_secrets(
    docs: DataFrame,
    text: str = "text",
    repository: str = "doc_id",
    owner: str = "source",
    copied_owners: int = 3,
    copied_repositories: int = 20,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Secrets of every text, each with how widely the corpus shares its value.

    Candidates are the base kinds and mixed runs of 20 or more letters and digits. Each
    candidate's value is hashed; over the whole corpus, its distinct repositories and owners
    are counted (per value, repository and owner first, then per value and owner, then per
    value, so that a value found everywhere is pre-aggregated in each task). A value with at
    least ``copied_owners`` owners is a widely copied example; any other looks live. A mixed run,
    which nothing but its rarity speaks for, is one with ``copied_repositories`` repositories
    too, whoever owns them. Mixed runs that look live and touch no base span become spans of
    the kind ``owned``. Places of a value that has over a thousandth of them all (at most 1,000
    values) are judged where they lie, by broadcast; the others by a join on the value.

    Returns a row for each input row: the columns named in ``keep``, base (base spans), spans
    (base and owned), live (spans whose value looks live), copied (those widely copied). A span
    is start, kind (index into KINDS), end (exclusive, code points) and value.

    Defined results: a null text is empty and has no spans; a null repository or owner counts
    as one of its own; repeated rows are one repository; an empty table gives an empty one.
    Columns of ``docs`` called like the new ones are not kept.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = base_spans(body)
    mixed = _when(body.rlike(_MIXED), _found(body, _MIXED, 0, "owned"))
    scanned = saved(
        docs.select(
            *(F.col(c) for c in keep),
            F.monotonically_increasing_id().alias("_row"),
            F.coalesce(F.xxhash64(F.col(repository).cast("string")), F.lit(0)).alias("_repository"),
            F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("_owner"),
            base.alias("base"),
            mixed.alias("_mixed"),
        ).withColumn(
            "_mixed",
            F.filter(
                "_mixed",
                lambda m: ~F.exists(
                    "base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])
                ),
            ),
        ),
        "secret-candidates",
    )
    every = F.concat("base", "_mixed")
    found = scanned.filter(F.size(every) > 0).select(
        "_row", "_repository", "_owner", F.explode(every).alias("span")
    )
    found = found.withColumn("_value", F.sha2(F.col("span.value"), 256))
    owners = saved(
        found.groupBy("_value", "_owner", "_repository")
        .agg(F.count(F.lit(1)).alias("places"))
        .groupBy("_value", "_owner")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("places").alias("places"))
        .groupBy("_value")
        .agg(
            F.count(F.lit(1)).alias("owners"),
            F.sum("n").alias("repositories"),
            F.sum("places").alias("places"),
        ),
        "secret-owners",
    )
    total = owners.agg(F.sum("places")).first()[0] or 0
    hot = F.broadcast(owners.filter(F.col("places") * 1000 > total))  # fewer than 1,000 rows
    rest = found.join(hot.select("_value"), "_value", "left_anti").join(owners, "_value")
    rare = (F.col("span.kind") != KINDS.index("owned")) | (
        F.col("repositories") < copied_repositories
    )
    judged = (
        found.join(hot, "_value")
        .unionByName(rest)
        .withColumn("_live", (F.col("owners") < copied_owners) & rare)
        .groupBy("_row")
        .agg(
            F.collect_list(F.when(F.col("_live"), F.col("span"))).alias("live"),
            F.collect_list(F.when(~F.col("_live"), F.col("span"))).alias("_copied"),
            F.max("owners").alias("most_owners"),
            F.max("repositories").alias("most_repositories"),
        )
    )
    none = F.expr(f"cast(array() as array<{_SPAN}>)")
    owned = F.filter("live", lambda s: s["kind"] == KINDS.index("owned"))
    base_kind = F.filter("_copied", lambda s: s["kind"] != KINDS.index("owned"))
    out = scanned.join(judged, "_row", "left").withColumn("live", F.coalesce("live", none))
    return out.select(
        *keep,
        "base",
        F.array_sort(F.concat("base", owned)).alias("spans"),
        F.array_sort("live").alias("live"),
        F.coalesce(F.array_sort(base_kind), none).alias("copied"),
        F.coalesce("most_owners", F.lit(0)).alias("most_owners"),
        F.coalesce("most_repositories", F.lit(0)).alias("most_repositories"),
    )


def _free(name: str, docs: DataFrame) -> str:
    """``name``, with marks behind it until no column of ``docs`` is called so."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def redact_secrets(docs: DataFrame, text: str = "text", mark: str = "<SECRET>", **scan) -> DataFrame:
    """``docs`` with the values of live-looking secrets replaced by ``mark``.

    Widely copied examples stay. Other columns stay as they are; a null text stays null. Only
    texts with candidates are set aside and joined with what the corpus says about them; the
    others pass straight through. Columns may have any names.
    """
    row, places = (_free(name, docs) for name in ("_redact_row", "_places"))
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    some = (F.size(base_spans(body)) > 0) | body.rlike(_MIXED)
    kept = saved(
        docs.filter(some).withColumn(row, F.monotonically_increasing_id()), "secret-texts"
    )
    spans = scan_secrets(kept, text, keep=(row,), **scan).filter(F.size("live") > 0)
    place = spans.select(
        row,
        F.transform(
            "live",
            lambda s: F.struct((s["end"] - F.length(s["value"])).alias("at"), s["end"].alias("end")),
        ).alias(places),
    )

    def join_overlaps(merged: Column, x: Column) -> Column:
        last = F.try_element_at(merged, F.lit(-1))
        longer = F.struct(
            last["at"].alias("at"), F.greatest(last["end"], x["end"]).alias("end")
        )
        return F.when(
            last["end"] > x["at"],
            F.concat(F.slice(merged, 1, F.size(merged) - 1), F.array(longer)),
        ).otherwise(F.concat(merged, F.array(x)))

    none = F.expr("cast(array() as array<struct<at:int,end:int>>)")
    redacted = F.aggregate(  # from the last place to the first, so that places stay valid
        F.reverse(F.aggregate(F.array_sort(places), none, join_overlaps)),
        F.col(text),
        lambda b, x: F.overlay(b, F.lit(mark), x["at"] + 1, x["end"] - x["at"]),
    )
    fixed = kept.join(place, row, "left").withColumn(
        text, F.when(F.col(places).isNull(), F.col(text)).otherwise(redacted)
    )
    return docs.filter(~some).unionByName(fixed.select(*docs.columns))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"), keep=("doc_id",))

    def count(kind: str) -> Column:
        of_kind = F.filter("base", lambda s: s["kind"] == KINDS.index(kind))
        return F.size(of_kind).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
        F.size("live").cast("bigint").alias("n_live"),
        F.size("copied").cast("bigint").alias("n_copied"),
        "most_owners",
    )
