"""Line dedup across documents: a deletion-neighbourhood join for lines one edit apart.

Everything is DataFrame expressions. Equal lines meet by a 128-bit hash under
map-side aggregation. Two lines within one edit share a half (the edit lies in
the other one), so only lines that share a half with another are candidates.
A candidate emits every variant with one character deleted as a hashed key; the
key of a variant is a difference of running sums over hashed characters, so a
line of any length costs in proportion to it. Lines that differ by one replaced
character share the variant and the place of the deletion; a line that lacks one
character of another equals its variant. Grouping by these keys gives the
earliest partner without listing the pairs of a group, and the texts of line and
partner are compared without the characters cut, in time linear in the line.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .texts import whole, written

#: Shorter lines are not compared for edits: short words are one character apart by chance.
LEAST_CHARS = 20
#: Equal lines go from so many characters on: all but blank ones.
LEAST_COPIED = 1
#: Up to so many hashes (16 bytes each) a table is broadcast; a larger one is joined by shuffling.
BROADCAST_ROWS = 500_000

# Hash seeds of the two sums, and bits of a hashed character.
# A text has less than 2^31 characters, so sums of 31-bit numbers stay below 62 bits; both together tell 2^62 texts apart.
SUM_SEEDS = (1, 2)
CHAR_BITS = 31
#: Lines are cut into characters block by block.
BLOCK_CHARS = 1 << 16

#: A place in the corpus is one number: id, nine digits that tell texts of one id apart, and nine of the line.
#: Numbers aggregate by hashing, which structs don't.
_PART, _OFFSET = 10**9, 1 << 63


def _document(id_col: str, text: str) -> Column:
    """Documents in the order of their ids, NULL ids last, as a number; equal for rows equal in id and text."""
    number = F.coalesce(F.col(id_col).cast("decimal(20,0)"), F.lit(Decimal(_OFFSET))) + F.lit(Decimal(_OFFSET))
    return (number.cast("decimal(20,0)") * F.lit(Decimal(_PART)) + F.pmod(F.xxhash64(whole(text)), F.lit(_PART))).cast("decimal(29,0)")


def _document_of(place: Column) -> Column:
    return ((place - place % F.lit(Decimal(_PART))) / F.lit(Decimal(_PART))).cast("decimal(29,0)")


def _line_of(place: Column) -> Column:
    return (place % F.lit(Decimal(_PART))).cast("int")


def _hashes(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(7), line).alias("h2")]


def _lines(docs: DataFrame, id_col: str, text: str, least_chars: int) -> DataFrame:
    """(at, line, h1, h2) of every line that takes part; spaces around it don't count."""
    first = F.col("document") * F.lit(Decimal(_PART))
    rows = docs.select(_document(id_col, text).alias("document"), whole(text).alias("text")).select(
        first.cast("decimal(38,0)").alias("start"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "raw")
    )
    lines = rows.select("start", "line_no", F.trim("raw").alias("line")).where(F.length("line") >= least_chars)
    at = (F.col("start") + F.col("line_no").cast("decimal(10,0)")).cast("decimal(38,0)")
    return lines.select(at.alias("at"), "line", *_hashes(F.col("line")))


def _half_keys(line: Column, n: Column) -> list[Column]:
    """Hashes of both halves of a line of ``n`` characters, as cut at the line's own length and at one more.

    A partner of the same length, or one character longer, is cut at its own
    length: it keeps the half that the edit isn't in, and so does this line.
    """
    keys = []
    for longer in (0, 1):
        m = n + longer
        head = F.floor(m / 2).cast("int")
        keys.append(F.xxhash64(m, F.lit(0), F.substring(line, F.lit(1), head)))
        keys.append(F.xxhash64(m, F.lit(1), F.substring(line, n - (m - head) + 1, m - head)))
    return keys


def _joined_by(df: DataFrame, small: DataFrame, on: list[str], limit: int) -> DataFrame:
    """Semi-join that broadcasts ``small``, a written table, if a count shows that it is small."""
    hinted = F.broadcast(small) if small.count() <= limit else small
    return df.join(hinted, on, "left_semi")


def _candidates(docs: DataFrame, distinct: DataFrame, id_col: str, text: str, least_chars: int, limit: int, folder: str | None) -> DataFrame:
    """(h1, h2, first, line): distinct lines that share a half with another line of fitting length."""
    halves = distinct.where("halves IS NOT NULL").select("h1", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low != high")
    shared = written(shared.select("half"), "shared-halves", folder)
    narrow = distinct.where("halves IS NOT NULL").select("h1", "h2", "first", F.explode("halves").alias("half"))
    chosen = _joined_by(narrow, shared, ["half"], limit).select("h1", "h2", "first").distinct()
    chosen = written(chosen, "candidates", folder)
    texts = _lines(docs, id_col, text, least_chars).select("h1", "h2", "line")
    texts = _joined_by(texts, chosen.select("h1", "h2"), ["h1", "h2"], limit)
    # Copies of a line are equal: any of them is its text.
    texts = texts.groupBy("h1", "h2").agg(F.first("line").alias("line"))
    return written(chosen.join(texts, ["h1", "h2"]), "candidate-texts", folder)


def _variants(candidates: DataFrame) -> DataFrame:
    """(at, cut, key): each candidate itself at cut 0 and with the character at ``cut`` deleted, as hashed keys.

    The sum of hashed (character, place) pairs stands for a text; deleting a
    character moves those behind it one place on, so a variant's sum is that of
    the characters before the cut and of the moved ones behind it.
    """
    starts = F.sequence(F.lit(0), F.length("line") - 1, F.lit(BLOCK_CHARS))
    block = lambda s: F.struct(s.alias("start"), F.substring("line", s + 1, F.lit(BLOCK_CHARS)).alias("text"))
    blocks = candidates.select(F.col("first").alias("at"), F.explode(F.transform(starts, block)).alias("block"))
    chars = blocks.select("at", F.col("block.start").alias("start"), F.posexplode(F.split("block.text", "")).alias("place", "char"))
    chars = chars.where("char != ''").select("at", (F.col("start") + F.col("place") + 1).alias("cut"), "char")
    term = lambda seed, place: F.shiftrightunsigned(F.xxhash64(F.lit(seed), "char", place), 64 - CHAR_BITS)
    terms = chars.select(
        "at", "cut",
        *[term(s, F.col("cut")).alias(f"own_{s}") for s in SUM_SEEDS],
        *[term(s, F.col("cut") - 1).alias(f"moved_{s}") for s in SUM_SEEDS],
    )
    line = Window.partitionBy("at").orderBy("cut")
    running = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = terms.select(
        "at", "cut",
        *[F.sum(f"own_{s}").over(running).alias(f"upto_{s}") for s in SUM_SEEDS],
        *[F.sum(f"moved_{s}").over(Window.partitionBy("at")).alias(f"all_{s}") for s in SUM_SEEDS],
        *[F.sum(F.col(f"own_{s}") - F.col(f"moved_{s}")).over(running).alias(f"less_{s}") for s in SUM_SEEDS],
        *[F.col(f"own_{s}") for s in SUM_SEEDS],
        F.lead("cut").over(line).isNull().alias("last"),
    )
    deleted = F.xxhash64(*[F.col(f"less_{s}") - F.col(f"own_{s}") + F.col(f"all_{s}") for s in SUM_SEEDS])
    itself = F.xxhash64(*[F.col(f"upto_{s}") for s in SUM_SEEDS])
    one = F.struct("cut", deleted.alias("key"))
    whole_line = F.struct(F.lit(0).alias("cut"), itself.alias("key"))
    both = F.when(F.col("last"), F.array(one, whole_line)).otherwise(F.array(one))
    return sums.select("at", F.explode(both).alias("v")).select("at", "v.*")


def _without(line: Column, cut: Column) -> Column:
    """The line without its character at ``cut``; 0 leaves it whole."""
    rest = F.concat(F.substring(line, F.lit(1), cut - 1), F.substring(line, cut + 1, F.length(line)))
    return F.when(cut > 0, rest).otherwise(line)


def _near(candidates: DataFrame, folder: str | None) -> DataFrame:
    """(h1, h2, earlier): distinct lines with an earlier line one edit apart, and the earliest such line's place."""
    group = Window.partitionBy("key")
    # A key's lines are different and share all but one character: they are few, whatever the input.
    shared = (
        _variants(candidates)
        .withColumn("low", F.min("at").over(group)).withColumn("high", F.max("at").over(group))
        .where("low != high").select("at", "cut", "key")
    )
    shared = written(shared, "shared-variants", folder)
    deleted, itself = shared.where("cut > 0"), shared.where("cut = 0")
    zero, other = F.lit(0), F.min("at").alias("other")
    pairs = [
        # One character replaced: the same variant by a cut at the same place.
        deleted.join(deleted.groupBy("key", "cut").agg(other), ["key", "cut"]).withColumn("other_cut", F.col("cut")),
        # One character more, or less, than an earlier line.
        deleted.join(itself.groupBy("key").agg(other), "key").withColumn("other_cut", zero),
        itself.join(deleted.groupBy("key").agg(other, F.min_by("cut", "at").alias("other_cut")), "key"),
    ]
    columns = ["at", "other", "cut", "other_cut"]
    found = pairs[0].select(*columns)
    for more in pairs[1:]:
        found = found.unionByName(more.select(*columns))
    # In a run of one character several cuts give the same variant.
    kind = [(F.col("cut") > 0).alias("shortened"), (F.col("other_cut") > 0).alias("other_shortened")]
    cuts = [F.min("cut").alias("cut"), F.min("other_cut").alias("other_cut")]
    found = found.where("other < at").groupBy("at", "other", *kind).agg(*cuts)
    mine = candidates.select(F.col("first").alias("at"), "h1", "h2", "line")
    theirs = candidates.select(F.col("first").alias("other"), F.col("line").alias("other_line"))
    checked = found.join(mine, "at").join(theirs, "other")
    close = _without(F.col("line"), F.col("cut")) == _without(F.col("other_line"), F.col("other_cut"))
    return checked.where(close).groupBy("h1", "h2").agg(F.min("other").alias("earlier"))


def repeated_lines(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text: str = "text",
    edits: int = 1,
    least_chars: int = LEAST_CHARS,
    least_copied: int = LEAST_COPIED,
    broadcast_rows: int = BROADCAST_ROWS,
    folder: str | None = None,
) -> DataFrame:
    """(at, earlier, near): every line to drop, where the line it repeats stands, and whether that one differs.

    ``at`` and ``earlier`` are places, numbers that stand for the document
    and the line number from 0. Ids are integers. Lines are the text between
    line feeds without spaces around them; equal ones count from ``least_copied``
    characters on, those that differ by an edit from ``least_chars`` on. A line
    goes if an equal line, or one within ``edits`` (0 or 1) inserted, deleted or
    replaced characters, stands earlier: in a document with a smaller id, or
    before it in the same one, whether or not that line stays itself. NULL ids
    come last, NULL texts count as empty. Rows equal in id and text are one
    document. An empty table gives no rows.
    """
    if edits not in (0, 1):
        raise ValueError("edits must be 0 or 1")
    if least_copied > least_chars:
        raise ValueError("least_copied must not exceed least_chars")
    lines = _lines(docs, id_col, text, min(max(1, least_copied), least_chars))
    narrow, parts, names = lines.select("at", "h1", "h2"), [], [f"half_{i}" for i in range(4)]
    if edits:
        # Each half is hashed once, before the aggregation.
        edited = F.col("n") >= least_chars
        keys = [F.when(edited, k).alias(h) for h, k in zip(names, _half_keys(F.col("line"), F.col("n")), strict=True)]
        narrow = lines.withColumn("n", F.length("line")).select("at", "h1", "h2", *keys)
        parts = [F.min(h).alias(h) for h in names]
    distinct = narrow.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.max("at").alias("last"), *parts)
    if edits:
        distinct = distinct.withColumn("halves", F.when(F.col("half_0").isNotNull(), F.array(*names))).drop(*names)
    distinct = written(distinct, "distinct-lines", folder)
    gone = distinct.where("last != first").select("h1", "h2", "first")
    if edits:
        candidates = _candidates(docs, distinct, id_col, text, least_chars, broadcast_rows, folder)
        near = _near(candidates, folder)
        gone = gone.join(near, ["h1", "h2"], "full_outer")
    else:
        gone = gone.withColumn("earlier", F.lit(None).cast("decimal(38,0)"))
    gone = written(gone, "gone", folder)
    # A line that very many documents share is one key here; adaptive execution splits it.
    places = lines.select("at", "h1", "h2").join(gone.hint("merge"), ["h1", "h2"])
    copy = F.col("at") != F.col("first")
    return places.where(F.col("earlier").isNotNull() | copy).select(
        "at", F.least("earlier", F.when(copy, F.col("first"))).alias("earlier"), (F.col("first").isNull() | ~copy).alias("near")
    )


def _with_gone(docs: DataFrame, gone: DataFrame, columns: list[Column], id_col: str, text: str) -> DataFrame:
    """The ``columns`` of each row, with the numbers of its lines to drop and of those that differ; NULL for none."""
    lists = gone.groupBy(_document_of(F.col("at")).alias("_document")).agg(
        F.collect_set(_line_of(F.col("at"))).alias("_gone"),
        F.collect_set(F.when(F.col("near"), _line_of(F.col("at")))).alias("_near"),
    )
    return docs.select(_document(id_col, text).alias("_document"), *columns).join(lists.hint("merge"), "_document", "left")


def _kept_text(text: Column) -> Column:
    """The lines between those that go, in time linear in the text: runs are cut out, nothing is looked up per line."""
    parts = F.struct(F.split(text, "\n", -1).alias("lines"), F.sort_array("_gone").alias("gone"))

    def runs(p: Column) -> Column:
        starts = F.concat(F.array(F.lit(-1)), p["gone"])
        ends = F.concat(p["gone"], F.array(F.size(p["lines"])))
        return F.flatten(F.zip_with(starts, ends, lambda s, e: F.slice(p["lines"], s + 2, e - s - 1)))

    # As a lambda's variable the lines are split once.
    kept = F.array_join(F.transform(F.array(parts), runs)[0], "\n")
    return F.when(F.col("_gone").isNull(), text).otherwise(kept)


def drop_repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with repeated lines taken out of the text; all columns and rows stay.

    A text that loses nothing is unchanged, NULL included; one that loses all
    its lines becomes empty. Rows equal in id and text are treated alike, and an
    empty table stays empty. Options are those of ``repeated_lines``.
    """
    gone = repeated_lines(docs, id_col=id_col, text=text, **options)
    whole_row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    joined = _with_gone(docs, gone, [whole_row], id_col, text)
    return joined.select(F.col("_row").withField(f"`{text}`", _kept_text(F.col(f"_row.`{text}`"))).alias("_row")).select("_row.*")


def line_report(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document: id, n_lines, n_repeated, n_near and the text that stays.

    n_repeated counts the lines dropped, n_near those of them without an equal
    earlier line. NULL texts count as empty, which is one line. An empty table
    gives no rows. Other columns are ignored.
    """
    gone = repeated_lines(docs, id_col=id_col, text=text, **options)
    columns = [F.col(id_col).alias("id"), whole(text).alias("text")]
    number = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long")
    return _with_gone(docs, gone, columns, id_col, text).select(
        F.col("id").alias(id_col), F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"),
        number("_gone").alias("n_repeated"), number("_near").alias("n_near"), _kept_text(F.col("text")).alias("text"),
    )
