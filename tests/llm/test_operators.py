"""The training-data operators against plain Python, and on awkward tables."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from paperfold.llm import (
    chat, components, encoding, exact_dedup, huffman, licenses, mixing, near_dedup, packing, pii, quality, token_counts,
    token_files,
)
from paperfold.session import shared_folder

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, tokens string, "
    "digest string, id bigint, uid string, words string, length string, `odd.name` int"
)
LONG = "Word another thing here. " * 8000 + "\n" + "9" * 30_000 + " " + "x" * 30_000 + "\n1 " + "2 3-4 " * 8000


def table(spark, rows):
    """Documents with further columns whose names operators use themselves."""
    extra = ("k", "t", "d", 7, "u", "w", "l", 1)
    return spark.createDataFrame([(*r, *extra) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "src0", 0),
        (3, " \t\n ", "en", "src0", 4),
        (4, LONG, "de", "src1", len(LONG)),
        (5, "mail me: a.b@c.de or +1 (017) 555-7713 \U0001f642", "en", "src2", 3),
        (5, "mail me: a.b@c.de or +1 (017) 555-7713 \U0001f642", "en", "src2", 3),
        (6, "one", None, "odd", 3),
        (7, "one ", "en", "src0", 4),
        (None, "no id here, none at all", "fr", "src3", 1),
        (8, "<|endoftext|></s> 　x\x00y\r\n\r\n  z᠎ ▁ ﻿", "fr", "src3", 1),
    ]
    return table(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


OPERATORS = {
    "mixing": mixing.mixed_documents,
    "token_counts": token_counts.token_counts,
    "packing": packing.packed_documents,
    "near": near_dedup.near_duplicates,
    "quality": quality.quality_rules,
    "pii": pii.personal_data,
    "licenses": licenses.license_scan,
    "exact": exact_dedup.exact_dedup,
}
STAGES = [quality.kept_documents, exact_dedup.kept_documents, near_dedup.kept_documents, mixing.kept_documents]


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_and_empty_tables(awkward, empty, name):
    assert OPERATORS[name](empty).collect() == []
    rows = OPERATORS[name](awkward).collect()
    if name not in ("mixing", "packing"):
        assert len(rows) == 10
        assert sorted((r.doc_id for r in rows), key=str) == sorted([1, 2, 3, 4, 5, 5, 6, 7, None, 8], key=str)


@pytest.mark.parametrize("stage", STAGES)
def test_stages_keep_columns(spark, awkward, empty, stage):
    assert stage(empty).collect() == []
    clean = table(spark, [(77, " ".join(f"word{k}" for k in range(40)), "en", "src9", 300)])
    out = stage(awkward.unionByName(clean))
    assert out.columns == awkward.columns
    assert 77 in {r.doc_id for r in out.collect()} or stage is mixing.kept_documents


def texts(awkward):
    return [(r.doc_id, r.text or "") for r in awkward.collect()]


def test_token_counts_equal_the_library(awkward):
    model = encoding.piece_model()
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(awkward).collect())
    want = [(str(d), len(t.encode()), n := len(model.encode(t)), n > 4096) for d, t in texts(awkward)]
    assert got == sorted(want)


PIECES = ["a", "the", " ", "  ", "\n", "\n\n", "\t", "é", "!", "'s", "　", "\x1c", "\x85", "<|endoftext|>", "</s>",
          "123", "᠎", "\0", "▁", "\r\n", "日本", "\U0001f642", " \n", "́", "Éa,", "ab.\ncd"]


def test_pieces_equal_whole_texts():
    rng = random.Random(5)
    encoder, counter = encoding.ByteEncoder(), encoding.PieceCounter({})
    tokenizer, model = encoding.byte_tokenizer(), encoding.piece_model()
    for _ in range(5000):
        text = "".join(rng.choices(PIECES, k=rng.randint(0, 12)))
        assert encoder.encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert counter.count(text) == len(model.encode(text))


def test_remembered_pieces_are_bounded():
    made = encoding._Remembering(len, limit=3)
    assert [made[x] for x in ("a", "bb", "ccc", "dddd", "a", "eeeee")] == [1, 2, 3, 4, 1, 5]
    assert len(made) <= 3 and len(made.older) <= 3


def test_token_files_round_trip(spark, awkward, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 500)
    folder = shared_folder(spark, "test-files")
    token_files.write_ids(awkward, folder)
    tokenizer = encoding.byte_tokenizer()
    want = {}
    start = 0
    for doc_id, text in sorted(texts(awkward), key=lambda x: -1 if x[0] is None else x[0]):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        want.setdefault(doc_id, []).append((start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = {}
    for r in token_files.read_checks(spark, folder).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in got.items()} == want
    for r in token_files.read_documents(spark, folder).collect():
        assert (r.start, r.n_tokens, zlib.crc32(r.ids)) in want[r.doc_id]


def test_token_files_of_nothing(spark, empty):
    folder = shared_folder(spark, "test-files")
    token_files.write_ids(empty, folder)
    assert token_files.read_checks(spark, folder).collect() == []


def test_huffman_code_is_complete_and_limited():
    rng = np.random.default_rng(3)
    for counts in (np.array([0, 5]), np.array([3, 0, 1]), 2 ** np.arange(40), rng.zipf(1.3, 5000) % 10_000):
        lengths = huffman.code_lengths(counts)
        used = lengths[counts > 0].astype(int)
        assert (lengths[counts == 0] == 0).all() and used.min() >= 1 and used.max() <= huffman.MAX_BITS
        if len(used) > 1:
            assert sum(2.0**-used) == 1
        ids = rng.choice(np.flatnonzero(counts), 3000)
        bits, offsets = huffman.pack(ids, lengths, huffman.canonical_codes(lengths))
        assert (huffman.unpack(bits, offsets, len(ids), huffman.decoding_table(lengths)) == ids).all()


def test_huffman_is_optimal_where_the_limit_does_not_bind():
    import heapq

    counts = np.random.default_rng(1).integers(1, 1000, 300)
    heap = [int(c) for c in counts]
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        pair = heapq.heappop(heap) + heapq.heappop(heap)
        total += pair
        heapq.heappush(heap, pair)
    assert (huffman.code_lengths(counts).astype(int) * counts).sum() == total


def fewest(lengths, capacity):
    """The fewest sequences for a few lengths, by trying."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def put(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for room in set(rooms):
            if room >= lengths[k]:
                i = rooms.index(room)
                put(k + 1, [*rooms[:i], room - lengths[k], *rooms[i + 1 :]])
        put(k + 1, [*rooms, capacity - lengths[k]])

    put(0, [])
    return best


def test_packing_plan_against_the_optimum():
    rng = random.Random(2)
    over = 0
    for _ in range(300):
        lengths = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        counts = {n: lengths.count(n) for n in lengths}
        plan = packing.packing_plan(counts, 20)
        best = fewest(lengths, 20)
        assert best <= plan.sequences <= best + 1
        over += plan.sequences > best
        # What the reduction fixes can be completed to an optimum.
        left, fixed = dict(counts), packing.Plan()

        def place(n, count, sequence, offset, each=1, left=left):
            left[n] -= count
            if not left[n]:
                del left[n]

        packing._fix_dominating(left, 20, fixed, place)
        assert fixed.sequences + fewest([n for n, c in left.items() for _ in range(c)], 20) == best
    assert over <= 6


@pytest.mark.parametrize("slices", [1, 256])
def test_packed_documents(spark, awkward, monkeypatch, slices):
    monkeypatch.setattr(packing, "SLICES", slices)
    rows = packing.packed_documents(awkward).collect()
    tokenizer = encoding.byte_tokenizer()
    pieces = {}
    for doc_id, text in texts(awkward):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) if len(ids) <= 2048 else len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids), 2048), len(ids)]
        for k, (a, b) in enumerate(itertools.pairwise(cuts)):
            pieces.setdefault((doc_id, k), []).append((a, b - a, zlib.crc32(ids[a:b].tobytes())))
    got = {}
    for r in rows:
        got.setdefault((r.doc_id, r.piece), []).append((r.start, r.length, r.ids_crc32))
    assert got == pieces
    assert_gapless(rows)


def assert_gapless(rows):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return by


def test_packing_is_tight_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.packed_documents(docs).collect()
    by = assert_gapless(rows)
    assert len(by) <= -(-sum(r.length for r in rows) // 2048) + 1


def test_sequences_hold_their_ids(awkward):
    packed = packing.pack(packing.token_pieces(awkward, with_ids=True))
    for r in packing.sequences(packed).collect():
        assert len(r.ids) == 4 * r.length


def shingles(text, size):
    words = (text or "").encode().lower().split()
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def groups_by_trying(rows, size, percent=80):
    """Smallest reachable id of each document, from all pairs."""
    sets = {d: shingles(t, size) for d, t in rows}
    ids = sorted(sets)
    smallest = {d: d for d in ids}

    def root(x):
        while smallest[x] != x:
            x = smallest[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((root(a), root(b)))
            smallest[y] = x
    return {d: root(d) for d in ids}, {d: len(s) for d, s in sets.items()}


def near_rows(seed, families, copies, changes):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(families):
        base = rng.choices(words, k=rng.randint(20, 60))
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randint(0, changes)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append(" ".join(text) if rng.random() < 0.8 else "  ".join(text).upper())
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("size,tile", [(2, 1000), (5, 7)])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, size, tile):
    monkeypatch.setattr(near_dedup, "TILE", tile)
    rows = near_rows(size, 12, 18, 5) + [(9000, ""), (9001, None), (9002, "solo"), (9003, "SOLO")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want, sizes = groups_by_trying(rows, size)
    got = near_dedup.near_duplicates(docs, shingle=size).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_one_large_group_of_near_copies(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(1500):
        text = list(base)
        text[rng.randrange(120)] = f"x{k}"
        rows.append((k, " ".join(text)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), shingle=2).collect()
    assert {r.component_id for r in got} == {0}


def test_looks_never_give_up_similar_pairs():
    looks = near_dedup.least_matches()
    rng = np.random.default_rng(0)
    same = rng.random((20_000, near_dedup.HASHES)) < 0.8
    a = np.zeros(same.shape, np.uint8)
    alive, _ = near_dedup.surviving(a, np.where(same, 0, 1).astype(np.uint8), looks)
    assert len(alive) >= 19_990
    far, _ = near_dedup.surviving(a, np.where(rng.random(same.shape) < 0.4, 0, 1).astype(np.uint8), looks)
    assert len(far) <= 5
    long = near_dedup.least_matches(ends=near_dedup.LONG_LOOKS)
    assert long[: len(looks)] == looks and [n for n, _ in long] == list(near_dedup.LONG_LOOKS)
    for s, share in ((0.8, 0.9995), (0.66, -0.01)):
        same = rng.random((5_000, near_dedup.LONG)) < s
        kept, _ = near_dedup.surviving(np.zeros(same.shape, np.uint8), np.where(same, 0, 1).astype(np.uint8), long)
        assert len(kept) >= share * 5_000 if share > 0 else len(kept) <= -share * 5_000


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(100)] + [(500, 500 + i) for i in range(1, 60)]
    edges += [(700 + i, 700 + (i + 1) % 9) for i in range(9)] + [(5, 5)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(101), 0), **dict.fromkeys(range(500, 560), 500), **dict.fromkeys(range(700, 709), 700)}
    none = spark.createDataFrame([], "a bigint, b bigint")
    assert components.components(none).collect() == []


def test_furniture_lines_are_removed_once_per_host(spark):
    line = "all rights of this page are with its host\n"
    own = "some words of my own number {0} that nobody else has written so far in {0} texts"
    rows = [(k, line + own.format(k), "en", "src1", 0) for k in range(12)]
    rows += [(100 + k, line + "ten words", "en", "src1", 0) for k in range(2)]
    rows += [(200 + k, own.format("many"), "en", "src1", 0) for k in range(50)]
    got = {r.doc_id: r for r in quality.quality_rules(table(spark, rows), line_limit=10).collect()}
    assert got[0].removed_words == 0 and got[1].removed_words == 9
    assert got[1].kept and got[100].depleted and not got[100].kept
    # Fifty copies of one text are one document; their line is no furniture.
    assert all(got[200 + k].removed_words == 0 for k in range(50))


def brute_base_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, f"email:{m.start()}:{m.end()}"))
    for m in re.finditer(r"[0-9]+(?:\.[0-9]+){3}", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, f"ip:{m.start()}:{m.end()}"))
    for m in re.finditer(r"[0-9](?:[\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        if 14 <= len(digits) <= 19:
            folded = [d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(reversed(digits))]
            if sum(folded) % 10 == 0:
                out.append((m.start(), 2, f"card:{m.start()}:{m.end()}"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, f"phone:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def test_personal_data_base_spans(spark, sf_dir):
    rng = random.Random(4)
    parts = ["a@b.c", "@", ".", "x.y@", "1.2.3.4", "300.1.1.1", "001.2.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112",
             "+1 (017) 555-7713", "+", "12", " ", "-", "\U0001f642", "é", "\n", "(", "..", "a@b.com_c@d.org", "378282246310005",
             "5", "+49 30 1234567", "99999999999999999999.1.1.1"]
    made = [(k, "".join(rng.choices(parts, k=rng.randint(1, 9)))) for k in range(1500)]
    real = [(10_000 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = made + real
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for doc_id, text in rows:
        base = brute_base_spans(text)
        row = got[doc_id]
        assert row.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), (text, row)
        assert set(base) <= set(filter(None, row.spans.split(",")))
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [
            sum(s.startswith(k) for s in base) for k in ("email:", "ip:", "card:", "phone:")
        ]


def test_secrets_are_added(spark):
    rows = [(k, f'some words token = "{hashlib.sha1(bytes([k])).hexdigest()}" and more') for k in range(40)]
    rows += [(100 + k, f"call me at (017) 555-77{k:02}") for k in range(40)] + [(500, "plain text without any")]
    got = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(got[k] == "secret:20:60" for k in range(40))
    assert all(got[100 + k].startswith("local:11:") for k in range(40))
    assert got[500] == ""


def test_votes_recover_planted_reliabilities():
    rng = random.Random(8)
    counts = {}
    truth = {}
    for _ in range(4000):
        true = rng.random() < 0.4
        votes = tuple((1 if true == (rng.random() < r) else -1) for r in (0.95, 0.9, 0.85, 0.6, 0.55))
        counts[votes] = counts.get(votes, 0) + 1
        truth.setdefault(votes, []).append(true)
    posterior = pii.estimated([("k", v, n) for v, n in counts.items()])
    right = sum(t == (posterior["k", v] > 0.5) for v, ts in truth.items() for t in ts)
    assert right / 4000 > 0.95


def brute_license(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    places, labels = [], set()
    for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")):
        p = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += found
        labels |= {label} if found else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_base_places(spark, sf_dir):
    rng = random.Random(6)
    parts = ["under", "the", "MIT", "License", "apache", "version", "2", "CC", "by", "nc", "4.0", "é", "K", " ", "-", "--", "\n", ", "]
    made = [(k, "".join(x + rng.choice([" ", "-", " ", ""]) for x in rng.choices(parts, k=rng.randint(1, 20)))) for k in range(800)]
    fixed = [
        (9000, "x under the MIT license under the mit license, CC--BY  NC; apache license version 2.0 y"),
        (9001, "understand the smit license"), (9002, None), (9003, "cc by ncx"), (9004, "cc\nby\tnc"),
    ]
    real = [(10_000 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = made + fixed + real
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for doc_id, text in rows:
        r = got[doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_license(text), text
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_rules_and_priorities(spark):
    rows = [
        (1, "This is licensed under the GNU Lesser General Public License, version 2.1 or later."),
        (2, "SPDX-License-Identifier: BSD-3-Clause"),
        (3, "Released under CC BY-NC-SA 4.0."),
        (4, "nothing to see here, under no terms"),
        (5, "Dual licensed under the Apache License 2.0; see also the MIT license."),
    ]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got[1] == ("lgpl-2.1", 0.95)
    assert got[2] == ("bsd-3", 1.0)
    assert got[3] == ("cc-by-nc,cc-by-nc-sa", 0.95)
    assert got[4] == ("", 0.0)
    assert got[5][0] == "apache-2,mit"


def test_exact_groups(spark):
    rows = [(5, "a  b"), (3, "a\tb"), (9, "a b"), (4, None), (7, ""), (8, "A b"), (None, "a b")]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {5: (3, 4, False), 3: (3, 4, True), 9: (3, 4, False), None: (3, 4, False), 4: (4, 2, True), 7: (4, 2, False), 8: (8, 1, True)}


def test_digest_index_persists_and_repeats(spark):
    folder = shared_folder(spark, "test-index")
    name = "index_" + folder.rsplit("-", 1)[-1]
    first = exact_dedup.DigestIndex(spark, name, folder, buckets=4)
    one = exact_dedup.marks(spark.createDataFrame([(1, "x"), (2, "y")], "doc_id bigint, text string"))
    first.append(one)
    first.append(one)
    spark.sql(f"DROP TABLE {name}")  # external: the files stay
    again = exact_dedup.DigestIndex(spark, name, folder, buckets=4)
    again.append(exact_dedup.marks(spark.createDataFrame([(0, "y"), (3, "z")], "doc_id bigint, text string")))
    assert sorted(r.keep_id for r in again.rows().collect()) == [1, 2, 3]


def test_appending_shuffles_only_the_delivery(spark):
    folder = shared_folder(spark, "test-index")
    index = exact_dedup.DigestIndex(spark, "plan_" + folder.rsplit("-", 1)[-1], folder, buckets=4)
    index.append(exact_dedup.marks(spark.createDataFrame([(1, "x"), (2, "y")], "doc_id bigint, text string")))
    delivery = exact_dedup.marks(spark.createDataFrame([(3, "x"), (4, "z")], "doc_id bigint, text string"))
    new = delivery.groupBy("digest").count().repartition(4, "digest").join(index.rows().select("digest").hint("merge"), "digest", "left_anti")
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.split("SortMergeJoin")[1].count("Exchange hashpartitioning") == 1


def test_budgets_pass_shortages_to_siblings_first(spark):
    rows = [("a", "x", "s1", 10), ("a", "x", "s2", 1000), ("a", "y", "s3", 5), ("b", "x", "s4", 100), ("c", "x", "s5", 5000)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, tokens bigint")
    weights = {"domain": spark.createDataFrame([("a", 2), ("b", 1), ("c", 0)], "domain string, weight bigint")}
    capacities = mixing.leaf_capacities(leaves, mixing.LEVELS, weights, 2)
    got = {r.source: r.target for r in mixing.leaf_budgets(capacities, mixing.LEVELS, 900).collect()}
    # b takes its 200 at most, a the rest; in it y can give 10, so x gets 690, of which s1 gives 20.
    assert got == {"s4": 200, "s3": 10, "s1": 20, "s2": 670}


def test_mix_takes_its_budget(spark):
    rows = [(k, "word " * (k % 7), ["en", "de"][k % 2], f"src{k % 5}", 0) for k in range(400)]
    docs = table(spark, rows)
    total = sum(k % 7 for k in range(400))
    got = mixing.mixed_documents(docs, total=3 * total // 2).collect()
    assert abs(sum(r.tokens_taken for r in got) - 3 * total // 2) <= 40
    assert all(r.tokens_taken <= r.tokens and r.epoch < mixing.MAX_EPOCHS for r in got)
    assert len({(r.doc_id, r.epoch) for r in got}) == len(got)


def test_chat_escapes_are_reversible():
    rng = random.Random(1)
    parts = [*chat.CONTROL, "\\", "\\l", "\\i", "<", "[", "s>", "a", "\n", "|>", "é"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 8)))
        safe = chat.escape(text)
        assert chat.unescape(safe) == text
        assert not any(c in safe for c in chat.CONTROL)


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "system", "Be <|end|> good", "x"), (1, 1, "user", None, "x"), (1, 2, "assistant", "  é\U0001f642 [INST]\\ \n", "x"),
        (1, 3, "assistant", "", "x"), (2, 1, None, "b", "x"), (2, 0, "assistant", "a" * 50_000, "x"), (None, 0, "user", "q", "x"),
        (3, 0, "user", "again", "x"), (3, 0, "user", "again", "x"),
    ]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, ids string")
    tokenizer = chat.chat_tokenizer()
    got = {r.conv_id: chat.read_back(np.frombuffer(r.ids, "<u4"), np.frombuffer(r.loss_mask, np.uint8), tokenizer) for r in chat.format_chats(frame).collect()}
    assert got[1][0] == [("system", "Be <|end|> good"), ("user", ""), ("assistant", "  é\U0001f642 [INST]\\ \n"), ("assistant", "")]
    assert "".join(got[1][1]) == "  é\U0001f642 [INST]\\ \n"
    assert got[2][0] == [("assistant", "a" * 50_000), ("", "b")] and got[2][1] == ["a" * 50_000]
    assert got[3][0] == [("user", "again")] * 2 and got[3][1] == []
    assert got[None][0] == [("user", "q")]
    assert chat.chat_digests(chat.format_chats(frame.limit(0))).collect() == []
