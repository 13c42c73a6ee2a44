"""MinHash near-duplicates with tensored banding, links confirmed on the full shingle sets."""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermotrack.llm.common import components, null_safe, packed, saved, sized, unpacked
from thermotrack.llm.hashing import BASE, WordHashes, mixed, released, slices, window_hashes, words_of

WORDS = 5
PERCENT = 75
ROWS = 3  # minimum hashes in a half key
HALVES = 16  # half keys in each of the two collections: 256 tables from 96 minimum hashes
SEED = 20240229
STRAY_SHINGLES = 200_000  # in a block of classes that are compared with blocks of others
MEMBER_SHINGLES = 800_000
BLOCK_CELLS = 1 << 22  # pairs whose common shingles are counted at once


def shingle_set(text: bytes | None, words: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a shorter text is one shingle, an empty one none."""
    found = words_of(text, lower=True)
    if not found:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(cache.__getitem__, found), np.uint64, len(found))
    if len(found) < words:
        with np.errstate(over="ignore"):
            return window_hashes(hashes, len(found)) ^ (BASE * np.uint64(len(found)))
    return np.unique(window_hashes(hashes, words))


def near_duplicate_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT,
                          rows: int = ROWS, halves: int = HALVES, doc_id: str = "doc_id",
                          text: str = "text") -> DataFrame:
    """A row for each row of docs: id (its doc_id), text_hash, n_shingles, component_id, kept.

    Documents are linked when 100 * |A and B| >= percent * |A or B| for their sets of word shingles
    (A-Z lower-cased; fewer words than a shingle: the whole text is one shingle). component_id is the
    smallest doc_id that can be reached over links, kept says whether it is the document's own.

    Equal sets are one class from the start. Each class gets two collections of `halves` half keys,
    each of `rows` minimum hashes; a table key is a pair of one half key from either collection, so
    halves**2 tables cost only 2 * halves * rows minimum hashes. A pair of similarity s meets with
    probability (1 - (1 - s**rows)**halves)**2: 0.9997 at 0.75, and more above. Half keys that no
    other class shares are left out before keys are paired. In each table the classes are compared
    with the smallest one of their key. Two classes that share a table have been compared with the
    same one, so what is left are pairs within such a star that are not in one component yet: those
    that the star's centre didn't reach against the rest, in blocks of bounded size, of which only
    links leave the task. No pair that shares a table is left out, unless it is in one component
    already. Every link is confirmed on the full sets.

    Texts without words (null, empty, blank) have no shingle and link with nothing. Rows with the
    same doc_id stand for themselves and may share a component; a null doc_id takes part, but is
    never the smallest unless all are null. Repeated rows are copies. An empty table gives an empty
    one. Shingles and sets are known by 64 and 128 bit hashes.
    """
    whole = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("text_hash"),
                        F.col(text).cast("binary").alias("text"))
    signed = saved(_signatures(whole, words, rows, halves))
    classes = saved(
        signed.filter("n_shingles > 0").groupBy("set_id")
        .agg(F.min("id").alias("doc"), F.first("n_shingles").alias("n"),
             F.first("a").alias("a"), F.first("b").alias("b")))
    stars = saved(_stars(_live_halves(classes)))
    sets = saved(_sets_of(whole, classes, stars, words))
    links = saved(_confirmed(stars, sets, percent))
    roots = saved(components(links))
    across = _across(stars, roots, sets, percent)
    roots = _merged(roots, saved(across))
    member = classes.join(roots, F.col("set_id") == F.col("id"), "left").select(
        "set_id", "doc", F.coalesce("root", "set_id").alias("root"))
    least = member.groupBy("root").agg(F.min("doc").alias("least"))
    placed = saved(member.join(least, "root").select("set_id", "least"))
    found = signed.select("id", "text_hash", "n_shingles", "set_id").join(placed, "set_id", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("id"))
    return found.select("id", "text_hash", "n_shingles", component.alias("component_id"),
                        F.col("id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of docs without those that `near_duplicate_groups` doesn't keep: one document of each
    group stays, and every document that is in no group. Rows with one doc_id are one document."""
    groups = near_duplicate_groups(docs, doc_id=doc_id, text=text, **how)
    lost = saved(groups.filter("not kept").select("id", "text_hash").distinct())
    whole = packed(docs, id=F.col(doc_id), text_hash=F.xxhash64(text))
    return unpacked(null_safe(whole, sized(lost), ["id", "text_hash"], "left_anti"))


def _signatures(texts: DataFrame, words: int, rows: int, halves: int) -> DataFrame:
    """id, n_shingles, set_id (128 bits of the whole set), half keys a and b of either collection."""
    @released
    def run(batches):
        cache = WordHashes()
        rng = np.random.default_rng(SEED)
        seeds = rng.integers(0, 2**63, 2 * halves * rows).astype(np.uint64) * np.uint64(2)
        factors = rng.integers(0, 2**63, len(seeds)).astype(np.uint64) | np.uint64(1)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for begin, end in slices(texts):
                sets = [shingle_set(t, words, cache) for t in texts[begin:end]]
                counts = np.array([len(s) for s in sets])
                full = counts > 0
                keys = np.zeros((len(sets), 2 * halves), np.int64)
                if full.any():
                    keys[full] = _half_keys(np.concatenate(sets), counts[full], seeds, factors, rows)
                flat = pa.array(keys.reshape(-1))
                both = pa.FixedSizeListArray.from_arrays(flat, 2 * halves).cast(pa.list_(pa.int64()))
                digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                yield pa.record_batch(
                    [batch.column("id").slice(begin, end - begin),
                     batch.column("text_hash").slice(begin, end - begin),
                     pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), both],
                    names=["id", "text_hash", "n_shingles", "set_id", "keys"])

    kind = texts.schema["id"].dataType.simpleString()
    out = texts.mapInArrow(run, f"id {kind}, text_hash bigint, n_shingles bigint, set_id binary, keys array<bigint>")
    return out.select("id", "text_hash", "n_shingles", "set_id", F.slice("keys", 1, halves).alias("a"),
                      F.slice("keys", halves + 1, halves).alias("b"))


def _half_keys(values, counts, seeds, factors, rows):
    """(documents, half keys): each half key mixes `rows` minimum hashes."""
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    out = np.zeros((len(counts), len(seeds) // rows), np.uint64)
    with np.errstate(over="ignore"):
        for i, (seed, factor) in enumerate(zip(seeds, factors, strict=True)):
            least = np.minimum.reduceat((values ^ seed) * factor, starts)
            out[:, i // rows] = mixed(out[:, i // rows] * BASE + least)
    return out.view(np.int64)


def _live_halves(classes: DataFrame) -> DataFrame:
    """set_id, n, la, lb: the (number, half key) of a class that other classes share, hashed."""
    sides = [
        classes.select("set_id", "n", F.lit(side).alias("side"), F.posexplode(side).alias("at", "value"))
        for side in ("a", "b")
    ]
    halves = sides[0].union(sides[1]).select(
        "set_id", "n", "side", F.xxhash64("side", "at", "value").alias("half"))
    shared = saved(halves.groupBy("half").agg(F.count("*").alias("n_classes"))
                   .filter("n_classes > 1").select("half"))
    kept = halves.join(sized(shared), "half")
    of = lambda side: F.collect_list(F.when(F.col("side") == side, F.col("half")))
    return (kept.groupBy("set_id", "n").agg(of("a").alias("la"), of("b").alias("lb"))
            .filter((F.size("la") > 0) & (F.size("lb") > 0)))


def _stars(live: DataFrame) -> DataFrame:
    """Distinct pairs (a, b): each class with the smallest class that shares a table key with it."""
    keys = live.select("set_id", F.explode("la").alias("half"), "lb").select(
        "set_id", "half", F.explode("lb").alias("other")).select(
        "set_id", F.xxhash64("half", "other").alias("key"))
    least = keys.groupBy("key").agg(F.min("set_id").alias("b"), F.count("*").alias("n_classes"))
    return (keys.join(least.filter("n_classes > 1").select("key", "b"), "key")
            .filter("set_id <> b").select(F.col("set_id").alias("a"), "b").distinct())


def _sets_of(whole: DataFrame, classes: DataFrame, stars: DataFrame, words: int) -> DataFrame:
    """set_id, n, shingles of the classes in stars, made again from one text of each."""
    used = stars.select(F.col("a").alias("set_id")).union(stars.select("b")).distinct()
    wanted = saved(classes.select("set_id", "doc").join(used, "set_id", "left_semi"))
    texts = null_safe(whole.select("id", "text"), sized(wanted.select(F.col("doc").alias("id"))), ["id"], "left_semi")
    found = _sets(texts, words).join(sized(wanted, 64), "set_id", "left_semi").dropDuplicates(["set_id"])
    return found.withColumn("n", F.size("shingles"))


def _confirmed(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that hold on the full sets; pairs whose sizes alone forbid it get no sets."""
    sizes = lambda side: sets.select(F.col("set_id").alias(side), F.col("n").alias(f"n_{side}"))
    fitting = stars.join(sizes("a"), "a").join(sizes("b"), "b").filter(
        100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    shingles = lambda side: sets.select(F.col("set_id").alias(side), F.col("shingles").alias(f"s{side}"))
    both = fitting.join(shingles("a"), "a").join(shingles("b"), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.filter(100 * shared >= percent * (F.col("n_a") + F.col("n_b") - shared)).select("a", "b")


def _across(stars: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between classes of one star that are in different components.

    Strays, the members outside of the centre's component, meet all members of other components.
    Both are dealt into blocks by size, so a task holds some STRAY_SHINGLES and MEMBER_SHINGLES at
    most, however large the star. A stray is given one link to each component that it reaches.
    """
    root_of = lambda df, key: df.join(roots.select(F.col("id").alias(key), "root"), key, "left").withColumn(
        "root", F.coalesce("root", key))
    members = root_of(stars.select(F.col("b").alias("centre"), F.col("a").alias("set_id")), "set_id")
    centres = root_of(stars.select(F.col("b").alias("centre")).distinct(), "centre").withColumnRenamed("root", "home")
    members = members.join(centres, "centre").withColumn("stray", F.col("root") != F.col("home"))
    members = members.join(sets.select("set_id", "n"), "set_id")
    mixed = members.groupBy("centre").agg(
        F.count("*").alias("size"), F.count_if("stray").alias("strays"),
        F.ceil(F.sum("n") / MEMBER_SHINGLES).cast("int").alias("member_blocks"),
        F.ceil(F.sum(F.when(F.col("stray"), F.col("n"))) / STRAY_SHINGLES).cast("int").alias("stray_blocks"),
    ).filter("size > 1 and strays > 0")
    chosen = saved(members.select("centre", "set_id", "root", "stray").join(mixed.drop("size", "strays"), "centre"))
    rows = chosen.join(sets.select("set_id", "shingles"), "set_id")
    own = lambda blocks: F.pmod(F.xxhash64("set_id"), F.col(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    kept = ("centre", "set_id", "root", "shingles")
    strays = rows.filter("stray").select(*kept, own("stray_blocks").alias("i"), every("member_blocks").alias("j"))
    others = rows.select(*[F.col(c).alias(c) for c in kept], every("stray_blocks").alias("i"),
                         own("member_blocks").alias("j"))

    def compared(strays: pa.Table, others: pa.Table) -> pa.Table:
        a, b = _links_between(strays, others, percent) if strays.num_rows and others.num_rows else ([], [])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    block = ("centre", "i", "j")
    return strays.groupBy(*block).cogroup(others.groupBy(*block)).applyInArrow(compared, "a binary, b binary")


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Roots of the ids after links between their components: only the components are searched."""
    if links.isEmpty():
        return roots
    root_of = lambda end: roots.select(F.col("id").alias(end), F.col("root").alias(f"root_{end}"))
    lifted = links.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left").select(
        F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    higher = saved(components(lifted).select(F.col("id").alias("root"), F.col("root").alias("top")))
    moved = roots.join(higher, "root", "left").select("id", F.coalesce("top", "root").alias("root"))
    single = higher.join(roots, F.col("id") == higher["root"], "left_anti").select(
        F.col("root").alias("id"), F.col("top").alias("root"))
    return moved.union(single)


def _links_between(strays: pa.Table, others: pa.Table, percent: int):
    """Of each stray, one link to each other component: ids of both ends. The common shingles are
    counted for so many strays at a time that the counts stay below BLOCK_CELLS."""
    order = np.argsort(others.column("set_id").to_numpy(zero_copy_only=False))
    others = others.take(pa.array(order))
    step, a, b = max(1, BLOCK_CELLS // others.num_rows), [], []
    for begin in range(0, strays.num_rows, step):
        left, right = _counted_links(strays.slice(begin, step), others, percent)
        a += left
        b += right
    return a, b


def _counted_links(strays: pa.Table, others: pa.Table, percent: int):
    values, owners, sizes = zip(*[_flat(t.column("shingles")) for t in (strays, others)], strict=True)
    shared = np.intersect1d(values[0], values[1])
    both = []
    for v, o in zip(values, owners, strict=True):
        v, o = v[keep := np.isin(v, shared)], o[keep]
        by_value = np.argsort(v, kind="stable")
        both.append(np.split(o[by_value], np.searchsorted(v[by_value], shared[1:])))
    counts = np.zeros((len(sizes[0]), len(sizes[1])), np.int32)
    for s, o in zip(*both, strict=True):
        counts[s[:, None], o] += 1
    linked = 100 * counts >= percent * (sizes[0][:, None] + sizes[1] - counts)
    roots = [np.array(t.column("root").to_pylist(), object) for t in (strays, others)]
    ids = [t.column("set_id").to_pylist() for t in (strays, others)]
    a, b = [], []
    for i in np.flatnonzero(linked.any(axis=1)):
        reached = {roots[0][i]}
        for j in np.flatnonzero(linked[i]):
            if roots[1][j] not in reached:
                reached.add(roots[1][j])
                a.append(ids[0][i])
                b.append(ids[1][j])
    return a, b


def _flat(column):
    """All values of a list column, the row of each, and the length of each row."""
    rows = column.combine_chunks()
    sizes = np.diff(rows.offsets.to_numpy())
    return rows.flatten().to_numpy(), np.repeat(np.arange(len(rows)), sizes), sizes


def _sets(texts: DataFrame, words: int) -> DataFrame:
    @released
    def run(batches):
        cache = WordHashes()
        for batch in batches:
            rows = batch.column("text").to_pylist()
            for begin, end in slices(rows):
                sets = [shingle_set(t, words, cache) for t in rows[begin:end]]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                flat = pa.array(np.concatenate(sets).view(np.int64))
                yield pa.record_batch(
                    [pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                     pa.ListArray.from_arrays(pa.array(ends), flat)], names=["set_id", "shingles"])

    return texts.select("text").mapInArrow(run, "set_id binary, shingles array<bigint>")
