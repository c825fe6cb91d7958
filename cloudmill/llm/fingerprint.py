"""Homomorphic multiset fingerprints of documents, in DataFrame functions only."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloudmill.llm.common import table

WIDE = 16  # lanes of 32 bits: sums of hash halves modulo 2**32, for equality
THIN = 60  # lanes of single hash bits, for likeness: two of 31 bits in one sum modulo 2**62
_PACKED = THIN // 2
# A paragraph is a line, cut behind sentence ends so that long lines are no single item.
PARAGRAPH = r"\n|(?<=[.!?])\x20+"


def lanes(paragraph: Column) -> list[Column]:
    """The vector of one paragraph: WIDE lanes, packed THIN lanes, and a lane that counts."""
    halves: list[Column] = []
    for k in range(WIDE // 2):
        h = F.xxhash64(paragraph, F.lit(k))
        halves += [h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)]
    bits = F.xxhash64(paragraph, F.lit(WIDE))

    def moved(bit: int, to: int) -> Column:
        only = bits.bitwiseAND(F.lit(1 << bit))
        return F.shiftleft(only, to - bit) if to >= bit else F.shiftrightunsigned(only, bit - to)

    thin = [moved(2 * k, 0).bitwiseOR(moved(2 * k + 1, 31)) for k in range(_PACKED)]
    return [*halves, *thin, F.lit(1).cast("bigint")]


def _names() -> list[str]:
    return [*(f"w{k}" for k in range(WIDE)), *(f"t{k}" for k in range(_PACKED)), "items"]


def _modulus(name: str) -> int:
    return {"w": 1 << 32, "t": 1 << 62, "i": 1 << 62}[name[0]]


def sum_lanes(paragraphs: DataFrame, keys: list[str], paragraph: str = "paragraph") -> DataFrame:
    """Fingerprint vectors: a row for each key, columns ``vector`` (array of sums).

    Sums are commutative, so the order of paragraphs does not matter, and ``combine`` adds or
    removes paragraphs later without the rest of the text. Sums and counters hold for fewer
    than 2**31 paragraphs a key, more than a string can have; a key of more raises an error.
    """
    with_lanes = paragraphs.select(
        *keys, *(v.alias(n) for v, n in zip(lanes(F.col(paragraph)), _names(), strict=True))
    )
    sums = with_lanes.groupBy(*keys).agg(
        *(F.pmod(F.sum(n), F.lit(_modulus(n))).alias(n) for n in _names())
    )
    return sums.select(*keys, F.array(*_names()).alias("vector"))


def combine(left: Column, right: Column, sign: int = 1) -> Column:
    """The vector of a text with (sign 1) or without (-1) the paragraphs of another vector."""
    return F.array(
        *(
            F.pmod(left[k] + F.lit(sign) * right[k], F.lit(_modulus(n)))
            for k, n in enumerate(_names())
        )
    )


def as_text(vector: Column) -> Column:
    """Fixed-width lower-case hexadecimal: wide lanes, thin lanes, then the count."""

    def joined(first: int, count: int, width: int) -> Column:
        part = F.slice(vector, first, count)
        return F.array_join(F.transform(part, lambda x: F.lpad(F.hex(x), width, "0")), "")

    ends = (joined(1, WIDE, 8), joined(WIDE + 1, _PACKED, 16), F.hex(F.element_at(vector, -1)))
    return F.lower(F.concat_ws("-", *ends))


def _signed(vector: Column) -> Column:
    """Ones minus zeros of each thin lane."""
    packed = F.slice(vector, WIDE + 1, _PACKED)
    ones = F.flatten(
        F.transform(
            packed,
            lambda x: F.array(
                *(F.shiftrightunsigned(x, k).bitwiseAND(F.lit(0x7FFFFFFF)) for k in (0, 31))
            ),
        )
    )
    return F.transform(ones, lambda x: (2 * x - F.element_at(vector, -1)).cast("double"))


def likeness(left: Column, right: Column) -> Column:
    """1 for equal vectors, else the cosine of the thin lanes as signed sums, 0 at least.

    Shared paragraphs add the same signs on both sides, different ones signs at random, so the
    cosine estimates the shared part.
    """

    def dot(a: Column, b: Column) -> Column:
        products = F.zip_with(_signed(a), _signed(b), lambda x, y: x * y)
        return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)

    size = F.sqrt(dot(left, left) * dot(right, right))
    cosine = F.when(size > 0, dot(left, right) / size).otherwise(F.lit(0.0))
    near = F.least(F.greatest(cosine, F.lit(0.0)), F.lit(1.0))
    return F.when(left == right, F.lit(1.0)).otherwise(near)


def _cells(docs: DataFrame, per_group: int, cells: int) -> tuple[DataFrame, DataFrame]:
    """Rows with a ``_cell`` each, runs of ``_key`` of about ``per_group`` rows; cells' counts.

    Every level counts the rows of each cell and splits those that are too full evenly between
    their own least and greatest key, into two parts for each group's worth of rows. Ids that lie
    apart from all others cost a level, not a full cell. A cell of one key stays whole. No level
    makes more than 2 * ``cells`` parts, which bounds the counts that the driver sees of it.
    """
    spark = docs.sparkSession
    docs = docs.withColumn("_cell", F.lit(0))
    number = 1
    while True:
        held = docs.groupBy("_cell").agg(
            F.count(F.lit(1)).alias("n"), F.min("_key").alias("first"), F.max("_key").alias("last")
        )
        rows = held.collect()
        full = [r for r in rows if r["n"] > 2 * per_group and r["first"] < r["last"]]
        share = max(per_group, -(-sum(r["n"] for r in full) // cells))
        full = [r for r in full if r["n"] > 2 * share]
        if not full:
            return docs, held
        split = []
        for r in full:
            wanted = 2 * r["n"] // share  # some parts will be fuller than others
            width = -(-(r["last"] - r["first"] + 1) // wanted)
            split.append((r["_cell"], number, Decimal(r["first"]), Decimal(width)))
            number += -(-(r["last"] - r["first"] + 1) // width)
        parts = F.broadcast(  # no more than a row for each two parts
            spark.createDataFrame(
                split, "_cell int, _base int, _low decimal(38,0), _width decimal(38,0)"
            )
        )
        part = F.expr("(cast(_key as decimal(38,0)) - _low) div _width")
        docs = (
            docs.join(parts, "_cell", "left")
            .withColumn("_cell", F.coalesce(F.col("_base") + part.cast("int"), "_cell"))
            .drop("_base", "_low", "_width")
        )


def with_next(
    docs: DataFrame, id_column: str, cells: int = 1 << 17, per_group: int = 4000
) -> tuple[DataFrame, list[str]]:
    """Deal rows out so that each group holds a run of ids and, last, the row that follows it.

    Neighbouring cells (see ``_cells``) make groups of about ``per_group`` rows, or of about a
    ``cells``-th of the table where that is more. The driver sees the cells that hold rows and
    no text. The row after a group (after the last one: the first row of all) is added to it
    with ``_extra`` true. Returns the rows and the order within ``_group``.
    """
    key = F.coalesce(F.col(id_column).cast("bigint"), F.lit(-(1 << 63)))
    docs, held = _cells(docs.withColumn("_key", key), per_group, cells)
    groups: list[tuple[int, int]] = []  # group of each cell that holds rows
    firsts: list[tuple[int, int]] = []  # first id of each group
    size = per_group
    for row in held.orderBy("first").collect():
        if size >= per_group:
            firsts.append((len(firsts), row["first"]))
            size = 0
        groups.append((row["_cell"], len(firsts) - 1))
        size += row["n"]
    spark = docs.sparkSession
    of_cell = F.broadcast(spark.createDataFrame(groups, "_cell int, _group int"))
    before = [(k, (i - 1) % len(firsts)) for i, k in firsts]
    extra = F.broadcast(spark.createDataFrame(before, "_key bigint, _also int"))
    own = docs.join(of_cell, "_cell")
    both = own.join(extra, "_key", "left").withColumn(
        "_to",
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.col("_group").alias("group"), F.lit(False).alias("extra")),
                    F.struct(F.col("_also").alias("group"), F.lit(True).alias("extra")),
                ),
                lambda x: x["group"].isNotNull(),
            )
        ),
    )
    dealt = both.withColumns({"_group": F.col("_to.group"), "_extra": F.col("_to.extra")})
    return dealt.drop("_to", "_also", "_cell"), ["_extra", "_key"]


def fingerprint_edits(
    docs: DataFrame, text: str = "text", id_column: str = "doc_id"
) -> DataFrame:
    """Fingerprints of every text and of its edited text, and likenesses between them.

    The edited text has its last floor(n/4) code points replaced by the first as many of the
    next document by id. A fingerprint sums the vectors of all paragraphs modulo powers of two;
    see ``lanes``, ``combine`` and ``likeness``. Any number of paragraphs counts exactly. Texts cross the network once; the sums are
    taken where the rows lie.

    Returns id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Defined results: a null text is empty, which is one empty paragraph; null ids come first;
    rows with equal ids are ordered by a hash of their text; a single document follows itself;
    no rows give no rows; other columns are ignored.
    """
    source = docs.select(
        F.col(id_column).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )
    dealt, order = with_next(source, "doc_id")
    by_group = Window.partitionBy("_group").orderBy(*order, "_tie")
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("_next"), F.lit(1), quarter)
    )
    texts = (
        dealt.withColumn("_tie", F.xxhash64("text"))
        .withColumn("_next", F.lead("text").over(by_group))
        .withColumn("_place", F.row_number().over(by_group))
        .withColumn("_edited", F.when(~F.col("_extra"), edited))
    )
    keys = ["_group", "_place", "_extra", "doc_id", "n_chars", "edited_sha256", "which"]
    items = texts.select(
        "_group",
        "_place",
        "_extra",
        "doc_id",
        n.cast("bigint").alias("n_chars"),
        F.sha2(F.col("_edited"), 256).alias("edited_sha256"),
        F.posexplode(F.array("text", "_edited")).alias("which", "body"),
    ).filter(F.col("body").isNotNull())
    paragraphs = items.select(*keys, F.explode(F.split("body", PARAGRAPH, -1)).alias("paragraph"))
    vectors = sum_lanes(paragraphs, keys)
    each = vectors.groupBy(*keys[:-1]).agg(
        F.first(F.when(F.col("which") == 0, F.col("vector")), True).alias("own"),
        F.first(F.when(F.col("which") == 1, F.col("vector")), True).alias("edited"),
    )
    following = F.lead("own").over(Window.partitionBy("_group").orderBy("_place"))
    return (
        each.withColumn("_following", following)
        .filter(~F.col("_extra"))
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            as_text(F.col("own")).alias("fingerprint"),
            as_text(F.col("edited")).alias("edited_fingerprint"),
            likeness(F.col("own"), F.col("edited")).alias("near_edited"),
            likeness(F.col("own"), F.col("_following")).alias("near_next"),
        )
    )


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))
