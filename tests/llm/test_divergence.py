"""Source divergence against plain Python."""

import random
import re
from collections import Counter, defaultdict

import pytest

from paperfold.llm import divergence

SCHEMA = "doc_id bigint, text string, lang string, source string, term string, count int, rank string, entries string, `odd.name` int"
LOWER = {c: c + 32 for c in range(65, 91)}


def f(p, q):
    return (p - q) ** 2 // (p + q)


def plain(rows, least_docs=10):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        others = [s for g, s in groups if g == lang]

        def shares(count, kept=kept):
            n = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p, q = shares(counts[lang, source]), shares(sum((counts[lang, s] for s in others), Counter()))
        pairs = [(sum(f(p[t], x[t]) for t in kept), s) for s in others if s != source for x in [shares(counts[lang, s])]]
        terms = [(f(p[t], q[t]), t) for t in kept if counts[lang, source][t] and p[t] > q[t]]
        for part, found, top in (("pair", pairs, len(pairs)), ("term", terms, 10)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, k + 1) for k, (value, item) in enumerate(found[:top])]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(*r, "t", 1, "r", "e", 2) for r in rows], SCHEMA)


@pytest.mark.parametrize("nodes", [1, 30, 200_000])
def test_audit_equals_plain_python(spark, monkeypatch, nodes):
    monkeypatch.setattr(divergence, "NODES", nodes)
    rng = random.Random(nodes)
    words = ["the", "The", "été", "É", "a", "b", "日本", "z_z", "x9y", "straße", "ÀB", *(f"w{'abcdefgh'[k % 8]}{'xyz'[k % 3]}" for k in range(24))]
    rows = []
    for k in range(220):
        lang, source = rng.choice(["en", "en", "en", None, "de"]), rng.choice(["s1", "s2", "S10", None, "s3", "é"])
        text = rng.choice([None, ""]) if rng.random() < 0.05 else " ".join(rng.choices(words, k=rng.randint(1, 12)))
        rows.append((rng.choice([None, k, 1]), text, lang, source))
    rows += [(900 + k, "the same words the same", "en", "s1") for k in range(60)]
    rows += [(1, None, "xx", "alone"), (2, "never often enough", "yy", "a"), (3, "x " * 30_000, "yy", "b"), (4, None, "en", "wordless")]
    assert sorted(map(tuple, divergence.source_divergence(table(spark, rows)).collect())) == plain(rows)


def test_empty_table(spark):
    assert divergence.source_divergence(table(spark, [])).collect() == []


def test_equal_beginnings_share_nodes():
    tree = divergence.Tree()
    tree.insert([(1, 2, 50, 5), (2, 1, 40, 4), (3, 1, 30, 3)], 7)
    tree.insert([(1, 2, 50, 5), (2, 1, 40, 4), (4, 9, 90, 9)], 2)
    assert len(tree.rows) == 4 and tree.rows[:2] == [9, 9]
    got = dict(((a, b), v) for a, b, v in tree.corrections())

    def both(a, b, a0, b0):
        return f(a, b) - f(a, b0) - f(a0, b) + f(a0, b0)

    assert got == {
        (1, 2): 9 * both(50, 40, 5, 4), (1, 3): 7 * both(50, 30, 5, 3), (2, 3): 7 * both(40, 30, 4, 3),
        (1, 4): 2 * both(50, 90, 5, 9), (2, 4): 2 * both(40, 90, 4, 9),
    }


def test_shares_are_exact_at_any_size(spark):
    rows = [(10**15, 3 * 10**15, 10**9), (0, 10**17, 7), (10**12 + 1, 10**12 + 1, 1)]
    df = spark.createDataFrame(rows, "c bigint, n bigint, v bigint")
    got = [r[0] for r in df.select(divergence.share(*(df[x] for x in "cnv"))).collect()]
    assert got == [1 + 10**9 * (c + 2) // (n + 2 * v) for c, n, v in rows]
