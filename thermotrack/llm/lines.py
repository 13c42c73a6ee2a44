"""Line deduplication by a segment-partition edit join, in DataFrame functions only."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermotrack.llm.common import WORD, components, null_safe, packed, saved, sized, unpacked
from thermotrack.plans.sided_join import salted

THRESHOLD = 2  # edits between two lines
EDIT_CHARS = 6  # an edit is allowed for each so many code points of the shorter line, up to THRESHOLD
BAG = "abcdefghijklmnopqrstuvwxyz0123456789 .,"


def let(value: Column, body) -> Column:
    """body(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def banded_distance(longer: Column, shorter: Column, threshold: int) -> Column:
    """Edit distance of two texts in code points if it is at most threshold, else some larger number.

    The cells within threshold of the diagonal are the bits of one number per column: the vertical
    differences +1 and -1. A column is computed from the one before by bit operations, and the
    diagonal that ends in the last cell is counted along the way. The band moves down a row with
    every character; cells outside of it count as larger. Rows above the table have no matches.
    """
    width = 2 * threshold + 1
    mask, top = (1 << width) - 1, 1 << (width - 1)
    rising = sum(1 << k for k in range(threshold, width))

    def distance(texts: Column) -> Column:
        ahead = F.size(texts["l"]) - F.size(texts["s"])

        def matches(c, j):
            bits = [F.when(F.get(texts["l"], j + (k - threshold)) == c, F.lit(1 << k)).otherwise(F.lit(0))
                    for k in range(width)]
            return sum(bits[1:], bits[0]).cast("bigint")

        def step(acc, x):
            vp, vn = acc["vp"], acc["vn"]
            sums = ((x.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(F.lit(mask))

            def columns(d):
                hp = vn.bitwiseOR(F.bitwise_not(d.bitwiseOR(vp)))
                hn = d.bitwiseAND(vp)

                def deltas(h):
                    up = F.shiftleft(hn, 1).bitwiseOR(F.bitwise_not(d.bitwiseOR(h))).bitwiseAND(F.lit(mask))
                    miss = 1 - F.call_function("shiftright", d, F.lit(threshold) + ahead).bitwiseAND(F.lit(1))
                    return _state(F.shiftright(up, 1).bitwiseOR(F.lit(top)),
                                  F.shiftright(d.bitwiseAND(h), 1), acc["score"] + miss)

                return let(F.shiftleft(hp, 1).bitwiseOR(F.lit(1)).bitwiseAND(F.lit(mask)), deltas)

            return F.when(acc["score"] > threshold, acc).otherwise(let(sums, columns))

        first = _state(F.lit(rising), F.lit(mask - rising), ahead)
        counted = F.aggregate(F.transform(texts["s"], matches), first, step, lambda acc: acc["score"])
        return F.when(ahead > threshold, ahead.cast("bigint")).otherwise(counted)

    return let(F.struct(_characters(longer).alias("l"), _characters(shorter).alias("s")), distance)


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _state(vp, vn, score) -> Column:
    return F.struct(vp.cast("bigint").alias("vp"), vn.cast("bigint").alias("vn"), score.cast("bigint").alias("score"))


def _places(threshold: int):
    """(shorter by, segment, move) of every key of a line: those of its own segments and the others."""
    for shorter in range(threshold + 1):
        for i in range(threshold + 1):
            low, high = max(-i, shorter - (threshold - i)), min(i, shorter + threshold - i)
            for move in range(low, high + 1):
                yield shorter, i, move


def _keys(threshold: int):
    """(edits, shorter by, segment, move) of every key of a line, for each number of allowed edits."""
    for edits in range(threshold, 0, -1):
        for place in _places(edits):
            yield edits, *place


def own_segments(threshold: int) -> list[int]:
    """Positions of a line's own segments among its keys."""
    return [at for at, (_, shorter, _, move) in enumerate(_keys(threshold)) if shorter == move == 0]


def allowed_edits(n: Column, threshold: int, edit_chars: int) -> Column:
    """Edits between two lines that are linked, of which the shorter one has n code points."""
    return F.least(F.lit(threshold), F.floor(n / edit_chars).cast("int"))


def with_segment_keys(lines: DataFrame, threshold: int, edit_chars: int = EDIT_CHARS) -> DataFrame:
    """lines (line, n) with keys array<bigint>: hashes of the segments of a line, and of the
    substrings that could be a segment of a line that is up to threshold characters shorter.

    A line that allows some edits is cut into one more even segments; a line within so many edits
    has one of them unchanged. Segment i, with i segments before and the rest after it, can have
    moved by at most i places counted from the left and by the rest counted from the right, which
    leaves few starts. Keys for lengths that allow another number of edits are null.
    """
    cut = lines.select("*", *[c for edits in range(1, threshold + 1) for shorter in range(edits + 1) for c in (
        F.expr(f"cast((n - {shorter}) div {edits + 1} as int)").alias(f"base_{edits}_{shorter}"),
        (edits + 1 - (F.col("n") - shorter) % (edits + 1)).alias(f"short_{edits}_{shorter}"))])
    keys = []
    for edits, shorter, i, move in _keys(threshold):
        base, short, n = F.col(f"base_{edits}_{shorter}"), F.col(f"short_{edits}_{shorter}"), F.col("n") - shorter
        size = base + (F.lit(i) >= short).cast("int")
        start = base * i + F.greatest(F.lit(0), F.lit(i) - short) + (move + 1)
        applies = n >= edits * edit_chars
        if edits < threshold:
            applies &= n < (edits + 1) * edit_chars
        # a start before the text would be counted from its end
        key = F.xxhash64(F.lit(i), n, F.substring("line", start, size))
        keys.append(F.when(applies & (start >= 1), key))
    return cut.select(*lines.columns, F.array(*keys).alias("keys"))


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """id, text_hash, line_no, line, n (code points), h (hash) of every line that has a word."""
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("text_hash"),
                       F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    rows = rows.filter(F.col("line").rlike(WORD))
    return rows.withColumn("n", F.length("line")).withColumn("h", F.xxhash64("line"))


def line_links(docs: DataFrame, threshold: int = THRESHOLD, edit_chars: int = EDIT_CHARS,
               doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Distinct pairs (a, b) of hashes of different lines within threshold edits of each other, and
    within one edit for each full edit_chars code points of the shorter one.

    Keys are made once and saved. Those that only one line has are dropped, by the smallest and largest
    line of each key, and the lines of the others are brought together by key; the rows of a key that
    many lines share are dealt to several tasks (`salted`). Within a key a pair must agree in its counts
    of letters up to twice the allowed edits before its distance is computed, and only linked pairs
    leave the join.
    """
    fuzzy = _lines(docs, doc_id, text).filter(F.col("n") >= edit_chars).select("h", "n", "line")
    keyed = saved(with_segment_keys(fuzzy, threshold, edit_chars).select("h", "n", "keys"))
    # the outer forms of explode keep Spark from working out the keys once more in a filter of its own
    keys = keyed.select("h", F.explode_outer("keys").alias("key")).filter("key is not null")
    live = saved(keys.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high"))
                 .filter("low <> high").select("key"))
    rows = keyed.select("h", "n", F.posexplode_outer("keys").alias("at", "key")).filter("key is not null")
    is_index = F.col("at").isin(own_segments(threshold)).alias("is_index")
    rows = saved(rows.join(sized(live), "key", "left_semi").select("key", "h", "n", is_index).distinct())
    named = saved(rows.select("h", "n").distinct())
    folded = F.lower("line")
    bag = F.array(*[(F.length(folded) - F.length(F.replace(folded, F.lit(c)))).cast("int") for c in BAG])
    texts = fuzzy.join(sized(named), ["h", "n"], "left_semi").groupBy("h", "n").agg(F.first("line").alias("line"))
    texts = saved(texts.withColumn("bag", bag))
    probe, index = salted(rows, rows.filter("is_index"), ["key"], "h")
    index = index.join(texts.hint("merge"), ["h", "n"]).alias("i")
    probe = probe.join(texts.hint("merge"), ["h", "n"]).alias("p")
    differ = F.aggregate(F.zip_with("i.bag", "p.bag", lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
    allowed = allowed_edits(F.col("i.n"), threshold, edit_chars)
    found = index.hint("merge").join(probe, [
        F.col("i.key") == F.col("p.key"), F.col("i._salt") == F.col("p._salt"), F.col("i.h") != F.col("p.h"),
        F.col("p.n") - F.col("i.n") <= allowed,
        ~F.col("p.is_index") | (F.col("i.h") < F.col("p.h")),
        differ <= 2 * allowed,
        banded_distance(F.col("p.line"), F.col("i.line"), threshold) <= allowed])
    return found.select(F.least("i.h", "p.h").alias("a"), F.greatest("i.h", "p.h").alias("b")).distinct()


def lines_to_drop(links: DataFrame, roots: DataFrame) -> DataFrame:
    """h of the lines that go: each is linked with a line that stays, and no two lines that stay are linked.

    Roots (h, root: first of each component) stay; among the others the smaller hash goes first. A round
    keeps every line that no undecided line goes before and drops what those are linked with. As hashes
    are spread at random, some log(lines) rounds suffice, however long the chains of links are.
    """
    rank = lambda c: F.struct((F.col(c) != F.col(f"root_{c}")).alias("later"), F.col(c).alias("h"))
    of = lambda c: roots.select(F.col("id").alias(c), F.col("root").alias(f"root_{c}"))
    ranked = links.join(of("a"), "a").join(of("b"), "b")
    edges = saved(ranked.select(F.least(rank("a"), rank("b")).getField("h").alias("before"),
                                F.greatest(rank("a"), rank("b")).getField("h").alias("after")))
    dropped = None
    while edges.limit(1).count():
        free = edges.select("before").distinct().join(
            edges.select(F.col("after").alias("before")).distinct().hint("merge"), "before", "left_anti")
        gone = saved(edges.join(free.hint("merge"), "before", "left_semi").select(F.col("after").alias("h")).distinct())
        dropped = gone if dropped is None else dropped.union(gone)
        for end in ("before", "after"):
            edges = edges.join(gone.withColumnRenamed("h", end).hint("merge"), end, "left_anti")
        edges = saved(edges.select("before", "after"))
    return dropped if dropped is not None else links.select(F.col("a").alias("h"))


def line_classes(docs: DataFrame, threshold: int = THRESHOLD, edit_chars: int = EDIT_CHARS,
                 doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each line that has a word: doc_id, text_hash, line_no, class_doc_id, class_line_no,
    root_doc_id, root_line_no, n_links, kept.

    Equal lines are one class, named by its first line (smallest doc_id, null last, then, for different
    texts of one id, the smaller text_hash, then line_no). Classes within threshold edits are linked.
    Lines of every length are compared; short ones by a relative rule, at most one edit for each full
    edit_chars code points of the shorter line: with 2 edits and 6 code points, 2 edits from 12 code
    points on, 1 from 6 to 11, none (equality) below. n_links counts the different other lines that a
    line is linked with; root is the first line that can be reached over links. A line is kept if it is
    the first of its class and its class stays: every class that goes is linked with one that stays
    (`lines_to_drop`), so a chain of links loses only lines beside a kept one.

    Null, empty and blank texts have no lines. Rows that repeat both doc_id and text are the same
    lines and are kept or dropped together. An empty table gives an empty one. Lines are known by a
    64 bit hash and their length.
    """
    occurrences = saved(_lines(docs, doc_id, text).select("id", "text_hash", "line_no", "h", "n"))
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash", "line_no")
    classes = occurrences.groupBy("h", "n").agg(F.min(place).alias("first"), F.count("*").alias("times"))
    links = saved(line_links(docs, threshold, edit_chars, doc_id, text))
    both = links.union(links.select("b", "a"))
    named = classes.select("h", "n", "first", "times")
    of_hash = saved(components(links))
    degrees = both.groupBy(F.col("a").alias("h")).agg(F.count("*").alias("n_links"))
    joined = named.join(of_hash.withColumnRenamed("id", "h"), "h", "left").join(degrees, "h", "left")
    placed = saved(joined.filter("times > 1 or n_links is not null"))
    least = placed.filter("root is not null").groupBy("root").agg(
        F.min(F.struct("first", "h")).alias("_least")).select(
        "root", F.col("_least.first").alias("root_first"), F.col("_least.h").alias("root_h"))
    first_of = saved(of_hash.join(least.select("root", "root_h"), "root").select("id", F.col("root_h").alias("root")))
    dropped = lines_to_drop(links, first_of).withColumn("dropped", F.lit(True))
    known = saved(placed.join(least, "root", "left").join(dropped, "h", "left").select(
        "h", "n", "first", F.coalesce("root_first", "first").alias("root_first"), "n_links", "dropped"))
    found = occurrences.join(sized(known, 160), ["h", "n"], "left")
    own = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash", "line_no")
    found = found.withColumn("first", F.coalesce("first", own)).withColumn("root_first", F.coalesce("root_first", own))
    return found.select(
        F.col("id").alias("doc_id"), "text_hash", F.col("line_no"),
        F.col("first.id").alias("class_doc_id"), F.col("first.line_no").alias("class_line_no"),
        F.col("root_first.id").alias("root_doc_id"), F.col("root_first.line_no").alias("root_line_no"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        (F.col("first").eqNullSafe(own) & F.col("dropped").isNull()).alias("kept"))


def dedup_lines(docs: DataFrame, threshold: int = THRESHOLD, edit_chars: int = EDIT_CHARS,
                doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with every line taken out of the text that `line_classes` doesn't keep.

    Blank lines stay. A document that had lines with words and loses all of them is a copy of others,
    line by line, and goes; documents without any word stay as they are.
    """
    lines = line_classes(docs, threshold, edit_chars, doc_id, text)
    lost = saved(lines.groupBy(F.col("doc_id").alias("id"), "text_hash").agg(
        F.collect_list(F.when(~F.col("kept"), F.col("line_no"))).alias("lost"),
        F.every("kept").alias("whole"), F.some("kept").alias("any")).filter("not whole").drop("whole"))
    n_lost = lost.agg(F.sum(F.size("lost"))).first()[0] or 0
    whole = packed(docs, id=F.col(doc_id), text_hash=F.xxhash64(text), text=F.col(text))
    joined = null_safe(whole, sized(lost, 64 + 8 * (n_lost // max(1, lost.count()) + 1)), ["id", "text_hash"])
    rest = let(F.struct(F.split("text", "\n", -1).alias("lines"), F.col("lost").alias("lost")), lambda t: F.array_join(
        F.transform(F.array_except(F.sequence(F.lit(0), F.size(t["lines"]) - 1), t["lost"]),
                    lambda i: F.get(t["lines"], i)), "\n"))
    kept = joined.filter(F.col("any") | F.col("any").isNull())
    return unpacked(kept, **{text: F.when(F.col("lost").isNull(), F.col("text")).otherwise(rest)}).select(
        *[F.col(f"`{c}`") for c in docs.columns])
