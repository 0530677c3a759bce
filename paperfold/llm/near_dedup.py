"""Near duplicates: banded minhashes, sequential Bayesian pruning, exact verification.

Documents with the same words count as one from the start. Each different text
gets a minhash signature; texts that agree in one band of it are candidates.
Candidates are compared over growing parts of their signatures, and a pair is
given up as soon as the posterior probability that its similarity reaches the
threshold falls below `MISS`. Survivors are verified on their full shingle sets.

No group is paired out. In a bucket (texts agreeing in a band) every member
meets the smallest one only. Links so confirmed are joined into components, and
just the members of a bucket that are still in different components meet each
other, in bounded tiles, inside a task that holds their shingles. There, pairs
that survive are verified at once, those already joined are skipped, and only
links that join two components leave the task: fewer than a tile has members. At
the end each two texts of a bucket are either in one component or were compared.

With 30 bands of 5, two texts at the threshold of 0.8 share no band with a
probability of 7e-6, and less above it.

Defined results: null and wordless texts have no shingles and link with nothing;
rows without a doc_id link as equal texts only; several rows of one doc_id are one
document, so texts under one doc_id are linked; further columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperfold.llm.components import components
from paperfold.llm.rows import ROW, numbered, without
from paperfold.session import as_table

SHINGLE = 5
PERCENT = 80
BANDS, ROWS = 30, 5
HASHES = BANDS * ROWS
# Hashes read at each look at the posterior. The longer signature is made only for
# members of a bucket that a first round of links leaves in different components.
LOOKS = (30, 60, 90, 120, 150)
LONG = 750
LONG_LOOKS = (*LOOKS, 300, 450, 600, 750)
# A pair is given up when its posterior chance of reaching the threshold is lower.
MISS = 1e-6
# Members of a bucket, and shingles of them, that a tile holds about at most.
TILE = 1000
TILE_SHINGLES = 500_000
# Ids of at most this many candidate texts are sent to all tasks (8 bytes each);
# beyond it the texts are shuffled to them.
BROADCAST_IDS = 2_000_000


def word_hashes(text: str | None):
    """64-bit hashes of the words, A-Z lower-cased; white space is ASCII's alone."""
    import numpy as np
    from xxhash import xxh3_64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def words_digest(words) -> bytes:
    from hashlib import blake2b

    return blake2b(words.tobytes(), digest_size=16).digest()


def shingle_hashes(words, size: int):
    """Sorted distinct hashes of all runs of `size` words; a shorter text is one run."""
    import numpy as np

    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total = _mixed(total * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n])
    return np.unique(total)


def _mixed(x):
    import numpy as np

    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def signature(shingles, multipliers, addends):
    """The smallest value of each hash function over the shingles, in slices of them."""
    import numpy as np

    low = np.full(len(multipliers), 0xFFFFFFFF, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(short), 2048):
        part = short[k : k + 2048]
        np.minimum(low, (multipliers[:, None] * part + addends[:, None]).min(axis=1), out=low)
    return low


def sketches(docs: DataFrame, shingle: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, digest of the words, n_shingles, sig (a byte per hash), bands (keys), and the columns `keep`."""

    def sketch(batches):
        import numpy as np
        import pyarrow as pa

        multipliers, addends = hash_functions(HASHES)
        numbers = np.arange(BANDS, dtype=np.uint64)
        for batch in batches:
            digests, sizes, sigs, bands = [], [], [], []
            for text in batch.column(1).to_pylist():
                words = word_hashes(text)
                shingles = shingle_hashes(words, shingle)
                digests.append(words_digest(words))
                sizes.append(len(shingles))
                low = signature(shingles, multipliers, addends)
                sigs.append(low.astype(np.uint8).tobytes())
                keys = numbers
                for column in low.reshape(BANDS, ROWS).T.astype(np.uint64):
                    keys = _mixed(keys * np.uint64(0x9E3779B97F4A7C15) + column)
                bands.append(keys.astype(np.int64))
            flat = pa.array(np.concatenate(bands)) if bands else pa.array([], pa.int64())
            ends = pa.array(np.arange(0, BANDS * len(bands) + 1, BANDS, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(digests, pa.binary()),
                    pa.array(sizes, pa.int64()),
                    pa.array(sigs, pa.binary()),
                    pa.ListArray.from_arrays(ends, flat),
                    *batch.columns[2:],
                ],
                names=["doc_id", "digest", "n_shingles", "sig", "bands", *keep],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *keep)
    kept = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(sketch, f"doc_id bigint, digest binary, n_shingles bigint, sig binary, bands array<bigint>{kept}")


def hash_functions(count: int):
    """Multipliers and addends of the first `count` hash functions."""
    import numpy as np

    random = np.random.RandomState(1)
    drawn = random.randint(0, 1 << 32, (LONG, 2), np.uint64).astype(np.uint32)
    return drawn[:count, 0] | np.uint32(1), drawn[:count, 1]


def least_matches(percent: int = PERCENT, miss: float = MISS, ends: tuple = LOOKS) -> list[tuple[int, int]]:
    """(hashes read, matches needed to go on) at each look.

    One byte of two different minhashes agrees once in 256, so a pair of
    similarity s matches with probability s + (1 - s) / 256. The prior on s is
    uniform.
    """
    import numpy as np

    s = (np.arange(20_000) + 0.5) / 20_000
    p = s + (1 - s) / 256
    looks, m = [], 0
    for n in ends:
        while True:  # the number needed grows with the number read
            like = m * np.log(p) + (n - m) * np.log1p(-p)
            like = np.exp(like - like.max())
            if like[s >= percent / 100].sum() / like.sum() >= miss:
                break
            m += 1
        looks.append((n, m))
    return looks


def surviving(a, b, looks):
    """Which rows of two byte matrices stay candidates after all looks, and their matches."""
    import numpy as np

    alive, matches, at = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for n, least in looks:
        matches[alive] += (a[alive, at:n] == b[alive, at:n]).sum(axis=1)
        alive, at = alive[matches[alive] >= least], n
    return alive, matches[alive]


def _pruned(pairs: DataFrame, uniques: DataFrame, looks) -> DataFrame:
    """Pairs (a, b) that survive, with the number of matching hashes."""
    sigs = uniques.select("id", "sig")
    joined = pairs.join(sigs.toDF("a", "sig_a"), "a").join(sigs.toDF("b", "sig_b"), "b")

    def prune(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            sides = [np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, HASHES) for k in (2, 3)]
            alive, matches = surviving(*sides, looks)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(alive)), batch.column(1).take(pa.array(alive)), pa.array(matches)],
                names=["a", "b", "matches"],
            )

    return joined.select("a", "b", "sig_a", "sig_b").mapInArrow(prune, "a bigint, b bigint, matches bigint")


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets reach the threshold."""
    joined = pairs.select("a", "b").join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")

    def verify(batches):
        import numpy as np
        import pyarrow as pa

        held_id, held = None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            good = []
            for k, (text_a, text_b) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                if b[k] != held_id:
                    held_id, held = b[k], shingle_hashes(word_hashes(text_b.as_py()), shingle)
                other = shingle_hashes(word_hashes(text_a.as_py()), shingle)
                common = len(held) + len(other) - len(np.union1d(held, other))
                if 100 * common >= percent * (len(held) + len(other) - common):
                    good.append(k)
            yield pa.RecordBatch.from_arrays(
                [pa.array([a[k] for k in good], pa.int64()), pa.array([b[k] for k in good], pa.int64())], names=["a", "b"]
            )

    return joined.select("a", "b", "text_a", "text_b").mapInArrow(verify, "a bigint, b bigint")


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components so far."""
    named = pairs
    for end in ("a", "b"):
        own = groups.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
        named = named.join(own, end, "left").withColumn(f"of_{end}", F.coalesce(f"of_{end}", end))
    return named.filter("of_a <> of_b").select(*pairs.columns)


def _undecided(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Members of buckets that hold several components: key, id, component, leader, tiles.
    A bucket of two has nothing more to meet: its leader met the other."""
    own = groups.select(F.col("node").alias("id"), "component")
    named = members.join(own, "id", "left").withColumn("component", F.coalesce("component", "id"))
    tiles = F.greatest(F.ceil(F.col("n") / TILE), F.ceil(F.col("shingles") / TILE_SHINGLES)).cast("int")
    mixed = (
        named.groupBy("key")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("n_shingles").alias("shingles"),
            F.min("component").alias("low"),
            F.max("component").alias("high"),
        )
        .filter("low <> high AND n > 2")
        .select("key", tiles.alias("tiles"))
    )
    return named.join(mixed, "key")


def _shingled(texts: DataFrame, shingle: int) -> DataFrame:
    """id, the longer signature (a byte per hash) and all shingles of some texts."""

    def sketch(batches):
        import numpy as np
        import pyarrow as pa

        functions = hash_functions(LONG)
        for batch in batches:
            sets = [shingle_hashes(word_hashes(text), shingle) for text in batch.column(1).to_pylist()]
            sigs = [signature(s, *functions).astype(np.uint8).tobytes() for s in sets]
            raw = [s.tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigs, pa.binary()), pa.array(raw, pa.binary())], names=["id", "sig", "shingles"])

    return texts.select("id", "text").mapInArrow(sketch, "id bigint, sig binary, shingles binary")


def _alike(a, b, percent: int) -> bool:
    """Whether two sorted sets of shingles reach the threshold."""
    import numpy as np

    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    small, large = (a, b) if len(a) < len(b) else (b, a)
    at = np.searchsorted(large, small)
    common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _tile_links(undecided: DataFrame, sets: DataFrame, looks, percent: int) -> DataFrame:
    """Links (a, b) that join members of a bucket which are in different components.

    Members of a bucket are dealt to tiles; every two tiles of a bucket meet in
    one task, which holds the signatures and shingles of both at a time. A pair
    is looked at in the first band its members share, and in no other.
    sets: id, sig, shingles, bands.
    """
    tile = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
    names = ("key", "t1", "t2", "tile", "id", "component", "leader", "sig", "shingles", "bands")
    rows = (
        undecided.join(sets, "id")
        .withColumn("tile", tile)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .withColumns({"t1": F.least("tile", "other"), "t2": F.greatest("tile", "other")})
        .select(*names)
    )

    def meet(batches):
        import pyarrow as pa

        held, now, found = [], None, set()
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(len(names))), strict=True):
                if row[:3] != now:
                    found.update(_joined(now, held, looks, percent))
                    held, now = [], row[:3]
                held.append(row[3:])
        found.update(_joined(now, held, looks, percent))
        pairs = sorted(found)
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

    dealt = rows.repartition("key", "t1", "t2").sortWithinPartitions("key", "t1", "t2", "id")
    return dealt.mapInArrow(meet, "a bigint, b bigint").distinct()


def _joined(place, rows: list, looks, percent: int) -> list[tuple[int, int]]:
    """Links that join the components of the members of two tiles, at most one fewer than those.
    place: bucket and tiles; rows: tile, id, component, leader, sig, shingles, bands; tiles of a pair meet each other,
    not themselves, unless it is one tile."""
    import numpy as np

    if len(rows) < 2:
        return []
    tile, ids, component, leader = (np.array([r[k] for r in rows], np.int64) for k in range(4))
    sig = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(len(rows), -1)
    sets = [np.frombuffer(r[5], np.uint64) for r in rows]
    bands = np.array([r[6] for r in rows], np.int64)
    key = place[0]
    _, group = np.unique(component, return_inverse=True)
    links, apart = [], place[1] != place[2]
    for i in range(len(rows)):
        j = np.arange(i + 1, len(rows))
        # The leader has met everybody.
        fit = (group[j] != group[i]) & (ids[j] != leader[i]) & (ids[i] != leader[i])
        if apart:
            fit &= tile[j] != tile[i]
        j = j[fit]
        if not len(j):
            continue
        first = np.argmax(bands[j] == bands[i], axis=1)
        j = j[bands[i][first] == key]
        if not len(j):
            continue
        alive, matches = surviving(np.broadcast_to(sig[i], (len(j), sig.shape[1])), sig[j], looks)
        for x in j[alive[np.argsort(-matches, kind="stable")]]:
            if group[x] != group[i] and _alike(sets[i], sets[x], percent):
                links.append((int(max(ids[i], ids[x])), int(min(ids[i], ids[x]))))
                group[group == group[x]] = group[i]
    return links


def _texts_of(docs: DataFrame, uniques: DataFrame, ids: DataFrame) -> DataFrame:
    """id and text of some different texts. Only a checked number of ids is broadcast."""
    few = ids.count() <= BROADCAST_IDS
    wanted = uniques.join(ids, "id", "left_semi").select("id", F.col("low").alias("doc_id"), "digest")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    known = wanted.select("doc_id").distinct()
    found = texts.join(F.broadcast(known) if few else known, "doc_id", "left_semi")

    def mark(batches):
        import pyarrow as pa

        for batch in batches:
            digests = [words_digest(word_hashes(text)) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary())], names=["doc_id", "text", "digest"])

    # A doc_id may stand for several texts.
    marked = found.select("doc_id", "text").mapInArrow(mark, "doc_id bigint, text string, digest binary")
    once = marked.groupBy("doc_id", "digest").agg(F.first("text").alias("text"))
    return as_table(once.join(wanted, ["doc_id", "digest"]).select("id", "text"), "candidate-texts")


def _same_documents(marked: DataFrame, uniques: DataFrame) -> DataFrame:
    """Links (a, b) between different texts of one doc_id."""
    worded = marked.filter("doc_id IS NOT NULL AND n_shingles > 0").select("doc_id", "digest")
    several = worded.groupBy("doc_id").agg(F.min("digest").alias("first"), F.max("digest").alias("last")).filter("first <> last")
    named = uniques.select("digest", "id")
    pairs = worded.join(several.select("doc_id", "first"), "doc_id").filter("digest <> first").distinct()
    firsts = named.select(F.col("digest").alias("first"), F.col("id").alias("one"))
    ends = pairs.join(named, "digest").join(firsts, "first")
    return ends.select(F.greatest("id", "one").alias("a"), F.least("id", "one").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, digest (of the words) of each row, and its columns `keep`."""
    looks = least_matches(percent)
    marked = as_table(sketches(docs, shingle, keep), "sketches")
    uniques = marked.groupBy("digest").agg(
        F.min("doc_id").alias("low"),
        F.max("n_shingles").alias("n_shingles"),
        F.first("sig").alias("sig"),
        F.first("bands").alias("bands"),
    )
    # A number of its own for each different text, stored with it.
    uniques = as_table(uniques.withColumn("id", F.monotonically_increasing_id()), "different-texts")
    keyed = uniques.filter("n_shingles > 0 AND low IS NOT NULL").select("id", "n_shingles", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = as_table(keyed.join(buckets.select("key", "leader"), "key"), "bucket-members")

    stars = members.filter("id <> leader").select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct()
    hopeful = as_table(_pruned(stars, uniques, looks), "survivors")
    ids = hopeful.select(F.col("a").alias("id")).unionByName(hopeful.select(F.col("b").alias("id"))).distinct()
    texts = _texts_of(docs, uniques, as_table(ids, "candidate-ids"))

    # One verification ties most members. A likely partner with a small id keeps the
    # graph of links shallow.
    likely = F.col("matches") >= percent * HASHES / 100
    first = hopeful.groupBy("a").agg(F.max_by("b", F.struct(likely.alias("likely"), -F.col("b"))).alias("b"))
    first = as_table(first, "first-pairs")
    links = _verified(first, texts, shingle, percent).unionByName(_same_documents(marked, uniques))
    links = as_table(links, "links")
    groups = components(links)
    # The other pairs with a leader are verified where they still matter.
    rest = hopeful.select("a", "b").join(first, ["a", "b"], "left_anti")
    apart = as_table(_apart(rest, groups), "apart-pairs")
    if not apart.isEmpty():
        links = as_table(links.unionByName(_verified(apart, texts, shingle, percent)), "links")
        groups = components(links)
    # Then all members of a bucket that are still apart meet.
    undecided = as_table(_undecided(members, groups), "undecided")
    if not undecided.isEmpty():
        texts = _texts_of(docs, uniques, as_table(undecided.select("id").distinct(), "late-ids"))
        sets = as_table(_shingled(texts, shingle).join(uniques.select("id", "bands"), "id"), "shingles")
        met = as_table(_tile_links(undecided, sets, least_matches(percent, ends=LONG_LOOKS), percent), "tile-links")
        if not met.isEmpty():
            groups = components(links.unionByName(met))

    classes = uniques.join(groups, F.col("id") == F.col("node"), "left").select(
        "digest", "low", "n_shingles", F.coalesce("component", "id").alias("group")
    )
    classes = as_table(classes, "classes")
    smallest = classes.groupBy("group").agg(F.min("low").alias("smallest"))
    named = classes.join(smallest, "group").select("digest", "n_shingles", "smallest")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("smallest"))
    return (
        marked.select("doc_id", "digest", *keep)
        .join(named, "digest")
        .select("doc_id", "n_shingles", component.alias("component_id"), "digest", *keep)
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """One row of each group, with all its columns. Rows without words belong to no
    group and stay; of rows without a doc_id that equal none with one, one stays."""
    rows = numbered(docs)
    found = as_table(near_duplicates(rows, keep=(ROW,)), "verdicts")
    group = (
        F.when(F.col("n_shingles") == 0, F.concat(F.lit("row "), F.col(ROW).cast("string")))
        .when(F.col("component_id").isNull(), F.concat(F.lit("text "), F.hex("digest")))
        .otherwise(F.col("component_id").cast("string"))
    )
    stay = found.filter("kept").groupBy(group.alias("group")).agg(F.min(ROW).alias(ROW))
    return without(rows, found.join(stay, ROW, "left_anti"))
