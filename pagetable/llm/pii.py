"""Personal data: patterns, and candidates that boosted trees select, in DataFrame functions alone.

Base spans follow fixed patterns with checks. High-recall generators propose further, overlapping
spans. Each candidate has features of its format. Gradient-boosted trees, which learn from cues before
candidates which formats are personal data, give it a score; a threshold per generator, set on held-out candidates for a stated precision,
decides which are taken, besides cued numbers and contacts. The trees are fitted on the driver to the counted feature vectors of all
documents and applied as one expression.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from pagetable.llm.common import whole_text

BASE_KINDS = ("email", "ip", "card", "phone")
# Possessive forms of the plain patterns: they match the same, in linear time and constant stack. A
# match begins where a run of its first characters does, or right behind the match before.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
EXTRA_KINDS = ("contact", "number", "secret")
GENERATORS = {
    "contact": r"(?:(?<![^\s<>()\[\],;:\"])|\G)[^\s@<>()\[\],;:\"]++@[^\s@<>()\[\],;:\"]++",
    "number": r"(?<![0-9A-Za-z])[+(]?[0-9](?:[ ().+-]{0,4}+[0-9]){6,}+(?![0-9A-Za-z])",
    "secret": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+",
}
# What says of a candidate that it is personal, whatever its format: words right before it.
CUES = {
    "contact": r"(?i)(?<![a-z])(?:e-?mail|mail|contact|write|reach|address)(?:\s(?:me|us|to|at|is|address))*\W{0,4}$",
    "number": r"(?i)(?<![a-z])(?:tel|telephone|phone|cell|cellphone|call|mobile|fax|card|visa|account|acct|iban|ssn|social security)"
    r"(?:\.?\s(?:me|us|at|on|is|number|no|nr))*\W{0,4}$",
    "secret": r"(?i)(?:token|secret|key|password|pwd|auth)\W{0,4}$",
}
CONTEXT = 40  # characters before a candidate in which a cue is looked for
TREES, RATE, RIDGE = 24, 0.4, 1.0
PRECISION = 0.9  # that held-out candidates over a threshold must have

SPAN = "struct<start:int,end:int,value:string>"
FEATURES = ("kind", "length", "digits", "digit_share", "separators", "dots", "plus", "at_dot", "mixed", "hexadecimal", "before")


def found(text: Column, pattern: str, when: Column) -> Column:
    """Leftmost non-overlapping matches as an array of ``start, end, value``, in code points.

    What a split at the pattern leaves and what matches take turns; their lengths add up to the places.
    """
    empty = F.array().cast(f"array<{SPAN}>")
    between = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    turns = F.zip_with(between, hits, lambda b, h: F.struct(F.length(b).alias("gap"), h.alias("hit")))
    walked = F.aggregate(
        F.filter(turns, lambda t: t["hit"].isNotNull()),
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda acc, t: F.struct(
            (acc["at"] + t["gap"] + F.length(t["hit"])).alias("at"),
            F.array_append(
                acc["out"],
                F.struct(
                    (acc["at"] + t["gap"]).alias("start"),
                    (acc["at"] + t["gap"] + F.length(t["hit"])).alias("end"),
                    t["hit"].alias("value"),
                ),
            ).alias("out"),
        ),
    )["out"]
    return F.when(when, walked).otherwise(empty)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    """Luhn's check; false for an empty string."""
    n = F.length(digits)

    def term(i):
        d = F.substr(digits, n - i + 1, F.lit(1)).cast("int")
        twice = 2 * d
        return F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    total = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda acc, i: acc + term(i))
    return (n > 0) & (total % 10 == 0)


def _holds(kind: str, value: Column) -> Column:
    """Whether a match of a base pattern passes its check."""
    digits = digits_of(value)
    if kind == "ip":
        # The last three digits decide once leading zeros are gone.
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.left(p, F.lit(3)).cast("int") <= 255))
    if kind == "card":
        return F.length(digits).between(13, 19) & passes_luhn(F.left(digits, F.lit(19)))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def with_base_spans(docs: DataFrame, text: str) -> DataFrame:
    """Adds ``_email, _ip, _card, _phone``: arrays of the base spans."""
    t = F.col(text)
    has = {"email": t.contains("@"), "phone": t.contains("+")}
    numeric = t.rlike("[0-9]")
    raw = docs.withColumns({f"_{k}": found(t, BASE[k], has.get(k, numeric)) for k in BASE_KINDS})
    return raw.withColumns({f"_{k}": F.filter(f"_{k}", _checked(k)) for k in BASE_KINDS})


def _checked(kind: str):
    return lambda span: _holds(kind, span["value"])


def _named(kind: str):
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))


def _bucket(value: Column, *edges: float) -> Column:
    return sum(((value >= e).cast("int") for e in edges), F.lit(0))


def _features(kind: int, text: Column, span: Column) -> Column:
    value = span["value"]
    n, digits = F.length(value), F.length(digits_of(value))
    context = F.substr(text, F.greatest(span["start"] - CONTEXT + 1, F.lit(1)), F.least(span["start"], F.lit(CONTEXT)))
    last = F.right(context, F.lit(1))
    each = {
        "kind": F.lit(kind),
        "length": _bucket(n, 8, 12, 16, 20, 28, 36, 48, 64),
        "digits": _bucket(digits, 1, 4, 7, 9, 12, 13, 16, 17, 20),
        "digit_share": _bucket(digits / n, 0.1, 0.3, 0.5, 0.8, 1.0),
        "separators": _bucket(F.regexp_count(value, F.lit(r"[ ()+/_-]")), 1, 2, 3, 5),
        "dots": _bucket(F.regexp_count(value, F.lit(r"\.")), 1, 2, 3, 4),
        "plus": value.startswith("+").cast("int"),
        "at_dot": value.rlike(r"@.*\w\.\w").cast("int"),
        "mixed": value.rlike(r"(?=.*[0-9])[A-Za-z]|[0-9].*[A-Za-z]").cast("int"),
        "hexadecimal": value.rlike(r"^[0-9a-f]+$").cast("int"),
        "before": F.when(last.isin('"', "'"), 2).when(last.isin("=", ":"), 1).otherwise(0),
    }
    return F.struct(
        span["start"].alias("start"), span["end"].alias("end"), _cued(kind, value, context).alias("label"),
        *[each[f].alias(f) for f in FEATURES],
    )


def _featured(kind: int, text: Column):
    return lambda span: _features(kind, text, span)


def _cued(kind: int, value: Column, context: Column) -> Column:
    """The label of a candidate: whether a cue stands before it. The trees see formats and never the cue."""
    cued = context.rlike(CUES[EXTRA_KINDS[kind]])
    return (cued & value.rlike("[0-9]") if EXTRA_KINDS[kind] == "secret" else cued).cast("int")


def with_candidates(docs: DataFrame, text: str) -> DataFrame:
    """Adds ``_candidates``: spans of all generators with features and training label."""
    t = F.col(text)
    has = {"contact": t.contains("@"), "number": t.rlike("[0-9]{2}"), "secret": t.rlike(r"[A-Za-z0-9+/_-]{16}")}
    raw = docs.withColumns({f"_c_{k}": found(t, GENERATORS[k], has[k]) for k in EXTRA_KINDS})
    lists = [F.transform(f"_c_{k}", _featured(i, t)) for i, k in enumerate(EXTRA_KINDS)]
    return raw.withColumn("_candidates", F.concat(*lists)).drop(*[f"_c_{k}" for k in EXTRA_KINDS])


class Trees(NamedTuple):
    """Trees of depth two: root and two lower splits (feature, bound), and four leaf values."""

    splits: tuple[tuple[tuple[int, int], ...], ...]
    leaves: tuple[tuple[float, ...], ...]
    bounds: tuple[float, ...]  # least chance per generator; above 1 takes none


def _boost(vectors, labels, weights) -> tuple[list, list]:
    """Newton boosting of depth-two trees on weighted 0/1 labels."""
    import numpy as np

    x, y, w = np.asarray(vectors), np.asarray(labels, float), np.asarray(weights, float)
    score, splits, leaves = np.zeros(len(y)), [], []

    def best(rows, g, h):
        top, at = 0.0, (0, 10**6)
        g, h = g[rows], h[rows]
        whole = g.sum() ** 2 / (h.sum() + RIDGE)
        for f in range(x.shape[1]):
            values = x[rows, f]
            below_g, below_h = np.cumsum(np.bincount(values, g)), np.cumsum(np.bincount(values, h))
            for bound in np.flatnonzero(np.bincount(values))[:-1]:
                gl, hl = below_g[bound], below_h[bound]
                gr, hr = g.sum() - gl, h.sum() - hl
                gain = gl * gl / (hl + RIDGE) + gr * gr / (hr + RIDGE) - whole
                if gain > top + 1e-9:
                    top, at = gain, (f, int(bound))
        return at

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = w * (y - p), w * p * (1 - p)
        every = np.arange(len(y))
        root = best(every, g, h)
        low = x[:, root[0]] <= root[1]
        left, right = best(every[low], g, h), best(every[~low], g, h)
        leaf = np.where(low, 1 - (x[:, left[0]] <= left[1]), 3 - (x[:, right[0]] <= right[1]))
        values = [
            RATE * float(g[leaf == k].sum() / (h[leaf == k].sum() + RIDGE)) for k in range(4)
        ]
        score = score + np.array(values)[leaf]
        splits.append((root, left, right))
        leaves.append(tuple(values))
    return splits, leaves


def _scores(trees: Trees, vectors):
    """The chance of every vector."""
    import numpy as np

    total = np.zeros(len(vectors))
    for (root, left, right), values in zip(trees.splits, trees.leaves):
        under = [vectors[:, f] <= bound for f, bound in (root, left, right)]
        total += np.where(under[0], np.where(under[1], *values[:2]), np.where(under[2], *values[2:]))
    return 1 / (1 + np.exp(-total))


def fit(docs: DataFrame, text: str = "text") -> Trees:
    """Trees and thresholds from the candidates of all documents.

    Spark counts the candidates by feature vector, and the counts reach the driver. A feature is one of at most ten steps, so
    there are under two million vectors whatever the documents hold, and few of them occur. Candidates that a base span
    overlaps are never chosen, so they are left out here too. A third of the texts sets the thresholds, by hash, so copies
    are in or out together. Null texts have no candidates; without any, as in an empty table, no tree is fitted and nothing
    but base and cued spans is found.
    """
    import numpy as np

    held_out = F.pmod(F.shiftright(F.xxhash64("_t"), 32), F.lit(3)) == 0
    # The outer form, as from the plain one Spark derives a filter that finds all candidates a second time.
    rows = _with_open_candidates(docs.select(F.col(text).alias("_t")), "_t").select(
        held_out.alias("held_out"), F.inline_outer("_candidates")
    )
    counts = {f"n{held}{label}": (F.col("held_out") == bool(held)) & (F.col("label") == label) for held in (0, 1) for label in (0, 1)}
    counted = rows.filter(F.col("label").isNotNull()).groupBy(*[F.col(f).cast("byte").alias(f) for f in FEATURES])
    got = counted.agg(*[F.count_if(when).alias(n) for n, when in counts.items()]).toArrow()
    got = got.sort_by([(f, "ascending") for f in FEATURES])
    vectors = np.column_stack([got[f].to_numpy() for f in FEATURES])
    n = {c: got[c].to_numpy() for c in counts}
    used = [n["n00"] > 0, n["n01"] > 0]
    if not (used[0].any() or used[1].any()):
        return Trees((), (), (2.0,) * len(EXTRA_KINDS))
    splits, leaves = _boost(
        np.concatenate([vectors[u] for u in used]),
        np.repeat([0, 1], [u.sum() for u in used]),
        np.concatenate([n["n00"][used[0]], n["n01"][used[1]]]),
    )
    trees = Trees(tuple(splits), tuple(leaves), ())
    chances = _scores(trees, vectors)
    bounds = []
    for kind in range(len(EXTRA_KINDS)):
        rows = (vectors[:, 0] == kind) & (n["n10"] + n["n11"] > 0)
        # Figures of all held-out candidates of at least a chance, from the highest chance down.
        chance, place = np.unique(-chances[rows], return_inverse=True)
        right = np.cumsum(np.bincount(place, n["n11"][rows]))
        seen = np.cumsum(np.bincount(place, (n["n10"] + n["n11"])[rows]))
        enough = np.flatnonzero((right >= PRECISION * seen) & (right > 0))
        bounds.append(-float(chance[enough[-1]]) - 1e-9 if len(enough) else 2.0)
    return trees._replace(bounds=tuple(bounds))


def _chance(trees: Trees, c: Column) -> Column:
    total = F.lit(0.0)
    for (root, left, right), values in zip(trees.splits, trees.leaves):
        side = [c[FEATURES[f]] <= bound for f, bound in (root, left, right)]
        total += F.when(side[0], F.when(side[1], values[0]).otherwise(values[1])).otherwise(
            F.when(side[2], values[2]).otherwise(values[3])
        )
    return 1 / (1 + F.exp(-total))


def _selected(trees: Trees, kind: int):
    # A cue settles a number or contact. A secret must also have the format of one.
    settled = EXTRA_KINDS[kind] != "secret"

    def chosen(c):
        likely = _chance(trees, c) >= trees.bounds[kind]
        likely = (c["label"] == 1) | likely if settled else likely
        return F.when(c["kind"] == kind, likely).otherwise(False)

    return chosen


def _with_open_candidates(docs: DataFrame, text: str) -> DataFrame:
    """Adds base span columns, ``_base`` with all of these, and ``_candidates`` that none of them overlaps."""
    rows = with_candidates(with_base_spans(docs, text), text)
    rows = rows.withColumn("_base", F.concat(*[F.transform(f"_{k}", _named(k)) for k in BASE_KINDS]))
    return rows.withColumn("_candidates", F.filter("_candidates", _apart))


def _apart(c: Column) -> Column:
    return ~F.exists("_base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))


def with_spans(docs: DataFrame, trees: Trees, text: str) -> DataFrame:
    """Adds base span columns and ``_spans``: all spans as ``kind, start, end``, by kind and start.

    A candidate that no base span overlaps is taken if its chance reaches its generator's threshold, and a
    number or contact also if a cue stands before it.
    """
    rows = _with_open_candidates(docs, text)
    taken = [
        F.transform(F.filter("_candidates", _selected(trees, i)), _named(kind))
        for i, kind in enumerate(EXTRA_KINDS)
    ]
    return rows.withColumn("_spans", F.concat("_base", *taken)).drop("_candidates")


def _shown(spans: Column | str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find(docs: DataFrame, trees: Trees | None = None) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` per row of ``doc_id, text``.

    Null texts count as empty. Map-only once the trees are there; without any given they are
    fitted to ``docs``.
    """
    rows = docs.select("doc_id", whole_text().alias("text"))
    trees = trees or fit(rows)
    return with_spans(rows, trees, "text").select(
        "doc_id",
        *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(_shown("_base"), 256).alias("base_sha256"),
        _shown("_spans").alias("spans"),
    )


def redact(docs: DataFrame, trees: Trees | None = None, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets.

    Of overlapping spans the first names what stands for all. A null text stays null; ``docs``
    keeps its columns.
    """
    kept = docs.columns
    rows = docs.select(F.struct("*").alias("_row"), F.coalesce(text, F.lit("")).alias("_t"))
    trees = trees or fit(rows.select(F.col("_t").alias("text")))
    spans = F.array_sort(F.transform("_spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), s["kind"].alias("kind"))))
    t = F.col("_t")
    walked = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], -s["less"]).alias("at"),
            F.when(s["start"] < acc["at"], acc["out"]).otherwise(
                F.array_append(acc["out"], F.concat(
                    F.substr(t, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]")
                ))
            ).alias("out"),
        ),
    )
    rest = F.substr(t, F.col("_walked.at") + 1, F.length(t))
    clean = F.concat(F.array_join("_walked.out", ""), rest)
    done = with_spans(rows, trees, "_t").withColumn("_walked", walked)
    new = F.when(F.col(f"_row.{text}").isNull(), F.lit(None)).when(F.size("_spans") == 0, t).otherwise(clean)
    return done.select(*[new.alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in kept])
