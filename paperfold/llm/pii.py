"""Personal data by weak supervision, in DataFrame functions alone.

Patterns propose spans. Five labelers (the kind's strict form, a structure test,
a gazetteer, words to the left, words to the right) vote on each for, against or
not at all. How far each labeler can be trusted is estimated by expectation
maximisation from how often each combination of votes occurs over all spans; the
posteriors then train a naive Bayes classifier of spans over votes, length and
the hashed words beside them. Combinations and features are bounded in number,
so what the estimation reads does not grow with the input.

Base spans (email, ip, card, phone in their fixed forms) always stay. The
classifier decides on the further kinds: `secret` (keys and tokens) and `local`
(telephone numbers without a country code), where they overlap no earlier span.

Defined results: a null or empty text has no spans; repeated rows are handled
row by row; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperfold.session import as_table

# The base kinds and their patterns. Guards and possessive loops do
# not change what matches; they keep long runs of letters or digits linear. A
# match may begin inside a run only where the match before it ended (\G).
_LOCAL_PART = "A-Za-z0-9._%+-"
BASE_KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL_PART}])|\G)[{_LOCAL_PART}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![0-9A-Za-z_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[0-9A-Za-z_-]{24,}+",
    "local": r"(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9])",
}
KINDS = tuple(PATTERNS)
# Texts that cannot hold a span of the kind are not searched for it.
_GATES = {
    "email": "@",
    "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){13}",
    "phone": r"\+[0-9]",
    "secret": r"[0-9A-Za-z_-]{24}",
    "local": r"[0-9]{3}[-.\x20][0-9]{4}",
}

# Gazetteers: endings of mail domains, first digits of card issuers, dialling codes.
DOMAIN_ENDINGS = "com org net edu gov info biz io dev app de fr es it nl uk us ca au jp cn in br ch at be pl se eu".split()
CARD_ISSUERS = "34 36 37 38 4 51 52 53 54 55 2221 2720 6011 62 64 65 35".split()
DIALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 52 55 60 61 62 63 64 65 66 81 82 84 86 90 91".split()
SECRET_PREFIXES = "sk pk ghp gho glpat xox AKIA eyJ key tok".split()
# Words that speak for a kind when they stand beside a span, and words that speak against all.
CUES = {
    "email": "mail email e-mail contact write kontakt courriel correo",
    "ip": "ip address host server adresse login",
    "card": "card visa credit mastercard amex karte carte tarjeta",
    "phone": "phone tel call fax mobile telefon telefono téléphone",
    "secret": "token key secret password apikey credential auth bearer",
    "local": "phone tel call fax mobile telefon telefono téléphone",
}
AGAINST = "version release isbn issn order invoice page section figure sha md5 commit doi"

LABELERS = ("form", "structure", "gazetteer", "left", "right")
_CONTEXT = 40
_ROUNDS = 60
# Buckets of words beside a span.
_BUCKETS = 256
# Posteriors are summed as whole millionths, so sums do not depend on their order.
_UNIT = 1_000_000


def candidates(docs: DataFrame) -> DataFrame:
    """uid, doc_id and, per kind, the matches with what lies before and beside them.

    Stored: several steps read it, and the row numbers must stay what they are.
    Texts themselves are not kept.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", text.alias("text"))
    gates = {k: F.col("text").contains(g) if g == "@" else F.col("text").rlike(g) for k, g in _GATES.items()}
    rows = rows.withColumns(
        {f"hits_{k}": F.when(gates[k], F.regexp_extract_all("text", F.lit(PATTERNS[k]), F.lit(0))) for k in KINDS}
    )
    rows = rows.withColumns(
        {f"gaps_{k}": F.when(F.size(f"hits_{k}") > 0, F.split("text", PATTERNS[k])) for k in KINDS}
    )

    def described(kind: str) -> Column:
        gaps = F.col(f"gaps_{kind}")
        return F.transform(
            f"hits_{kind}",
            lambda hit, k: F.struct(
                F.length(F.get(gaps, k)).alias("gap"),
                hit.alias("value"),
                F.right(F.get(gaps, k), F.lit(_CONTEXT)).alias("left"),
                F.left(F.get(gaps, k + 1), F.lit(_CONTEXT)).alias("right"),
            ),
        )

    return as_table(rows.select("uid", "doc_id", *[described(k).alias(k) for k in KINDS]), "span-candidates")


def placed(rows: DataFrame) -> DataFrame:
    """One row per match: uid, kind, start, end (code points), value, left, right."""
    each = None
    for number, kind in enumerate(KINDS):
        part = rows.filter(F.size(kind) > 0).select(
            "uid", F.lit(kind).alias("kind"), F.lit(number).alias("rank"), F.posexplode(kind).alias("at", "hit")
        )
        each = part if each is None else each.unionByName(part)
    so_far = Window.partitionBy("uid", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("hit.value")
    end = F.sum(F.col("hit.gap") + size).over(so_far)
    return each.withColumn("end", end).select(
        "uid", "kind", "rank", (F.col("end") - size).alias("start"), "end", "hit.value", "hit.left", "hit.right"
    )


def _digits() -> Column:
    return F.regexp_replace("value", "[^0-9]+", "")


def _luhn() -> Column:
    """Whether the digits pass the Luhn test."""
    backwards = F.reverse(_digits())
    figures = F.transform(
        F.sequence(F.lit(1), F.length(_digits())), lambda k: F.substr(backwards, k, F.lit(1)).cast("int") * (2 - k % 2)
    )
    total = F.aggregate(figures, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))
    return total % 10 == 0


def _octets() -> Column:
    short = F.transform(F.split("value", r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(short, lambda p: (F.length(p) <= 3) & (F.left(p, F.lit(3)).cast("int") <= 255))


def strict_form() -> Column:
    """Whether a span has its kind's strict form; for base kinds, the base test."""
    n = F.length(_digits())
    return (
        F.when(F.col("kind") == "email", F.lit(True))
        .when(F.col("kind") == "ip", _octets())
        .when(F.col("kind") == "card", F.when(n.between(14, 19), _luhn()).otherwise(False))
        .when(F.col("kind") == "phone", n.between(10, 15))
        .when(F.col("kind") == "secret", F.col("value").rlike("^(?:[0-9a-f]{32,}|[0-9A-F]{32,}|[0-9A-Za-z_-]{32,})$"))
        .otherwise(n == 10)
    )


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _any(words: str) -> str:
    return "(?i)(?<![\\p{L}])(?:" + "|".join(words.split()) + ")(?![\\p{L}])"


def voted(spans: DataFrame) -> DataFrame:
    """Spans with `base` (form test of a base kind) and the votes of all labelers."""
    kind, value = F.col("kind"), F.col("value")
    changes = F.length(F.regexp_replace(value, "[0-9]+", "#")) - F.length(F.regexp_replace(value, "[0-9]+", ""))
    sound = (
        F.when(kind == "email", value.rlike(r"^[A-Za-z0-9]") & value.rlike(r"\.[A-Za-z]{2,24}$"))
        .when(kind == "ip", ~value.rlike(r"^0") & ~value.rlike(r"(?:^|\.)0[0-9]"))
        .when(kind == "card", value.rlike(r"^[2-6]") & value.rlike(r"^(?:[0-9]+|[0-9]{4}[ -][0-9]{4}[ -].*|[0-9]{4}[ -][0-9]{6}[ -].*)$"))
        .when(kind == "phone", value.rlike(r"[ ().-]") & ~value.rlike(r"[ .-]{3}"))
        .when(kind == "secret", (changes >= 4) & ~value.rlike(r"[-_]{2}"))
        .otherwise(~value.rlike(r"^\(?0{3}"))
    )
    listed = (
        F.when(kind == "email", F.lower(F.regexp_extract("value", r"\.([A-Za-z]+)$", 1)).isin(DOMAIN_ENDINGS))
        .when(kind == "card", _digits().rlike("^(?:" + "|".join(CARD_ISSUERS) + ")"))
        .when(kind == "phone", _digits().rlike("^(?:" + "|".join(DIALLING_CODES) + ")"))
        .when(kind == "secret", value.rlike("^(?:" + "|".join(SECRET_PREFIXES) + ")"))
        .otherwise(False)
    )

    def beside(column: str) -> Column:
        says = F.lit(False)
        for name, words in CUES.items():
            says = F.when(kind == name, F.col(column).rlike(_any(words))).otherwise(says)
        return _vote(says, F.col(column).rlike(_any(AGAINST)))

    form = strict_form()
    return spans.withColumn("form_ok", form).select(
        *spans.columns,
        (kind.isin(*BASE_KINDS) & F.col("form_ok")).alias("base"),
        _vote(F.col("form_ok"), ~F.col("form_ok")).alias("form"),
        _vote(sound, ~sound).alias("structure"),
        _vote(listed, F.lit(False)).alias("gazetteer"),
        beside("left").alias("left_vote"),
        beside("right").alias("right_vote"),
    )


_VOTES = ("form", "structure", "gazetteer", "left_vote", "right_vote")


def estimated(patterns: list[tuple]) -> dict[tuple, float]:
    """Posterior of a true span for each (kind, votes), by expectation maximisation.

    `patterns`: (kind, votes, count), at most 3 ** labelers per kind. Each kind
    has its own share of true spans; a labeler has one distribution of votes on
    true and one on false spans, shared by all kinds and smoothed by one count.
    The start takes the majority of the votes.
    """
    posterior = {(k, v): 0.9 if sum(v) > 0 else 0.1 if sum(v) < 0 else 0.5 for k, v, _ in patterns}
    for _ in range(_ROUNDS if patterns else 0):
        share = defaultdict(lambda: [1.0, 1.0])
        seen = [[{-1: 1.0, 0: 1.0, 1: 1.0} for _ in range(2)] for _ in _VOTES]
        for kind, votes, n in patterns:
            p = posterior[kind, votes]
            for true, weight in ((1, p * n), (0, (1 - p) * n)):
                share[kind][true] += weight
                for labeler, vote in enumerate(votes):
                    seen[labeler][true][vote] += weight
        totals = [[sum(d.values()) for d in labeler] for labeler in seen]
        for kind, votes, _ in patterns:
            odds = math.log(share[kind][1] / share[kind][0])
            for labeler, vote in enumerate(votes):
                odds += math.log(seen[labeler][1][vote] / totals[labeler][1])
                odds -= math.log(seen[labeler][0][vote] / totals[labeler][0])
            posterior[kind, votes] = 1 / (1 + math.exp(-max(-40.0, min(40.0, odds))))
    return posterior


def with_posteriors(spans: DataFrame) -> DataFrame:
    counts = spans.groupBy("kind", *_VOTES).agg(F.count(F.lit(1)).alias("n")).collect()
    patterns = sorted((r.kind, tuple(r[v] for v in _VOTES), r.n) for r in counts)
    rows = [(kind, *votes, round(p * _UNIT)) for (kind, votes), p in sorted(estimated(patterns).items())]
    schema = "kind string, " + ", ".join(f"{v} int" for v in _VOTES) + ", soft bigint"
    table = spans.sparkSession.createDataFrame(rows, schema)
    # At most 3 ** labelers rows per kind.
    return spans.join(F.broadcast(table), ["kind", *_VOTES])


def classified(spans: DataFrame) -> DataFrame:
    """Spans with `log_odds` of the naive Bayes classifier trained on `soft`.

    Features are (kind, bucket) pairs, so each feature table has at most
    kinds * buckets rows, and one prior per kind.
    """
    word = F.lower(F.regexp_extract("left", r"([\p{L}]+)[^\p{L}]*$", 1)), F.lower(F.regexp_extract("right", r"^[^\p{L}]*([\p{L}]+)", 1))
    featured = spans.withColumns(
        {
            "f_left": F.pmod(F.xxhash64(word[0]), F.lit(_BUCKETS)).cast("int"),
            "f_right": F.pmod(F.xxhash64(word[1]), F.lit(_BUCKETS)).cast("int"),
            "f_size": F.least(F.length("value"), F.lit(_BUCKETS - 1)),
            "f_votes": sum((F.col(v) + 1) * 3**i for i, v in enumerate(_VOTES)).cast("int"),
        }
    )
    prior = featured.groupBy("kind").agg(F.sum("soft").alias("yes"), F.sum(_UNIT - F.col("soft")).alias("no"))
    scored = featured.join(F.broadcast(prior.select("kind", F.log((F.col("yes") + _UNIT) / (F.col("no") + _UNIT)).alias("log_odds"))), "kind")
    totals = prior.select("kind", F.col("yes").alias("all_yes"), F.col("no").alias("all_no"))
    for feature in ("f_left", "f_right", "f_size", "f_votes"):
        sums = featured.groupBy("kind", feature).agg(F.sum("soft").alias("yes"), F.sum(_UNIT - F.col("soft")).alias("no"))
        given = sums.join(F.broadcast(totals), "kind")
        smooth = _UNIT * _BUCKETS
        weight = F.log((F.col("yes") + _UNIT) / (F.col("all_yes") + smooth)) - F.log((F.col("no") + _UNIT) / (F.col("all_no") + smooth))
        scored = scored.join(F.broadcast(given.select("kind", feature, weight.alias("__w"))), ["kind", feature])
        scored = scored.withColumn("log_odds", F.col("log_odds") + F.col("__w")).drop("__w")
    return scored


def chosen(spans: DataFrame) -> DataFrame:
    """Base spans, and further spans the classifier takes that overlap none before them."""
    taken = spans.filter(F.col("base") | (~F.col("kind").isin(*BASE_KINDS) & (F.col("log_odds") > 0)))
    around = Window.partitionBy("uid").orderBy("start", "rank", "end")
    before = around.rowsBetween(Window.unboundedPreceding, -1)
    after = around.rowsBetween(1, Window.unboundedFollowing)
    marked = taken.withColumns(
        {
            "reach": F.max("end").over(before),
            "next": F.min(F.when(F.col("base"), F.col("start"))).over(after),
        }
    )
    free = (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.coalesce(F.col("next") >= F.col("end"), F.lit(True)))
    return marked.filter(F.col("base") | free)


def _listed(only_base: bool) -> Column:
    item = F.struct("start", "rank", F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string")).alias("said"))
    items = F.array_sort(F.collect_list(F.when(F.col("base"), item) if only_base else item))
    return F.array_join(F.transform(items, lambda x: x["said"]), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """Counts and digest of base spans, all spans, counts of the further kinds and
    whether there is any span, of each document."""
    rows = candidates(docs)
    spans = as_table(with_posteriors(as_table(voted(placed(rows)), "votes")), "spans")
    found = chosen(classified(spans))
    further = [k for k in KINDS if k not in BASE_KINDS]
    counts = [F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in BASE_KINDS]
    counts += [F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in further]
    per_document = found.groupBy("uid").agg(*counts, _listed(True).alias("base_spans"), _listed(False).alias("spans"))
    joined = rows.select("uid", "doc_id").join(per_document, "uid", "left")
    return joined.select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("bigint").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(F.coalesce("base_spans", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("bigint").alias(f"n_{k}") for k in further],
        F.col("spans").isNotNull().alias("private"),
    )
