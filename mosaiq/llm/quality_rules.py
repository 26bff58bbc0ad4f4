"""Quality rules: text statistics and a learned decision list, all as Spark expressions.

The main path holds DataFrame functions only. The list is fitted by sequential covering on a bounded
sample of labelled rows: each rule is a conjunction of thresholds, grown by information gain on two
thirds of the sample and pruned on the rest; a rule that isn't precise enough ends the list.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import SPACES, sample_by_hash

SYMBOLS = "#*$%&|<>"
_GAP = "[ \\t\\n\\x0B\\f\\r]+"
_STATS = "_mq_stats"
#: Longs of the statistics, in the order of the struct.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaim", "n_digits")
#: What rules may test: shares that don't depend on a text's length, and the length itself.
FEATURES = ("n_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "exclaim_share", "digit_share", "line_words")


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one struct column of counts, each made within its row: no shuffle, whole texts.

    Words are the runs without ASCII white space. n_repeat_words counts the words lying in a 3-word
    window that occurs twice or more: windows are hashed to 64 bits, sorted with their positions, and
    neighbours in that order compared, so the work is n log n in a text's length. Null text: zeros.
    """
    base = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("_mq_text", base).withColumn("_mq_trim", F.btrim(F.col("_mq_text"), F.lit(SPACES)))
    df = df.withColumn("_mq_words", F.when(F.col("_mq_trim") == "", F.array().cast("array<string>")).otherwise(F.split("_mq_trim", _GAP)))
    w = F.col("_mq_words")
    n = F.size(w)
    windows = F.when(
        n >= 4,
        F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("p")))),
    ).otherwise(F.array().cast("array<struct<h:bigint,p:int>>"))
    df = df.withColumn("_mq_windows", windows)
    s = F.col("_mq_windows")
    last = F.size(s) - 1

    def twin(x, i):
        return ((i > 0) & (s[F.greatest(i - 1, F.lit(0))]["h"] == x["h"])) | ((i < last) & (s[F.least(i + 1, last)]["h"] == x["h"]))

    df = df.withColumn("_mq_twins", F.sort_array(F.transform(F.filter(s, twin), lambda x: x["p"])))
    t = F.col("_mq_twins")
    covered = F.when(F.size(t) == 0, F.lit(0)).otherwise(
        F.aggregate(t, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + p + 3 - F.greatest(a["end"], p)).alias("n")), lambda a: a["n"])
    )
    df = df.withColumn("_mq_lines", F.filter(F.split("_mq_text", "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    lines = F.col("_mq_lines")
    body = F.col("_mq_text")

    def chars(pattern: str) -> Column:
        return F.length(body) - F.length(F.regexp_replace(body, pattern, ""))

    values = {
        "n_words": n,
        "word_chars": F.length(F.translate(body, SPACES, "")),
        "n_symbols": F.length(body) - F.length(F.translate(body, SYMBOLS, "")),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": covered,
        "n_lines": F.size(lines),
        "n_upper": chars("\\p{Lu}+"),
        "n_exclaim": F.length(body) - F.length(F.replace(body, F.lit("!"), F.lit(""))),
        "n_digits": chars("[0-9]+"),
    }
    # A generator of one row: filters on the counts stay above it, else Catalyst would copy the whole
    # computation into the predicate (and, within the lambdas, repeat it for every word).
    df = df.withColumn(_STATS, F.explode(F.array(F.struct(*[v.cast("long").alias(k) for k, v in values.items()]))))
    return df.drop("_mq_text", "_mq_trim", "_mq_words", "_mq_windows", "_mq_twins", "_mq_lines")


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def features(s: Column) -> dict[str, Column]:
    def share(a: str, b: str) -> Column:
        return s[a] / F.greatest(s[b], F.lit(1))

    return {
        "n_words": s["n_words"].cast("double"),
        "word_length": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "upper_share": share("n_upper", "word_chars"),
        "exclaim_share": share("n_exclaim", "word_chars"),
        "digit_share": share("n_digits", "word_chars"),
        "line_words": share("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Rule:
    """Reject where all (feature, at least?, threshold) hold."""

    conditions: tuple[tuple[str, bool, float], ...]
    precision: float = 0.0
    covered: int = 0

    def holds(self, row: dict[str, float]) -> bool:
        return all((row[f] >= t) if at_least else (row[f] < t) for f, at_least, t in self.conditions)

    def expression(self, cols: dict[str, Column]) -> Column:
        out = F.lit(True)
        for f, at_least, t in self.conditions:
            out = out & ((cols[f] >= F.lit(t)) if at_least else (cols[f] < F.lit(t)))
        return out

    def __str__(self) -> str:
        return "reject if " + " and ".join(f"{f} {'>=' if a else '<'} {t:.6g}" for f, a, t in self.conditions)


@dataclass
class DecisionList:
    rules: list[Rule] = field(default_factory=list)

    def verdict(self, s: Column) -> Column:
        """Number of the first rule that rejects, from 1; 0 where none does."""
        cols = features(s)
        out = None
        for i, r in enumerate(self.rules, 1):
            out = F.when(r.expression(cols), i) if out is None else out.when(r.expression(cols), i)
        return F.lit(0) if out is None else out.otherwise(0)


def learn(rows: list[tuple[dict[str, float], bool]], max_rules: int = 12, max_conditions: int = 4, precision: float = 0.9, thresholds: int = 48) -> DecisionList:
    """Sequential covering over (features, is bad) rows; every third row, in their order, prunes."""
    grow, prune = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if not i % 3]
    found: list[Rule] = []
    for _ in range(max_rules):
        if sum(bad for _, bad in grow) < 5:
            break
        rule = _pruned(_grown(grow, max_conditions, thresholds), prune or grow)
        if rule is None:
            break
        hit = [bad for x, bad in grow + prune if rule.holds(x)]
        if len(hit) < 5 or sum(hit) < precision * len(hit):
            break
        found.append(Rule(rule.conditions, sum(hit) / len(hit), len(hit)))
        grow, prune = [r for r in grow if not rule.holds(r[0])], [r for r in prune if not rule.holds(r[0])]
    return DecisionList(found)


def _grown(rows, max_conditions: int, thresholds: int) -> Rule:
    conditions: tuple = ()
    for _ in range(max_conditions):
        bad, all_ = sum(b for _, b in rows), len(rows)
        if not bad or bad == all_:
            break
        was, best = math.log2(bad / all_), None
        for f in FEATURES:
            values = sorted(((x[f], b) for x, b in rows), key=lambda v: v[0])
            below, step, cum = 0, max(1, all_ // thresholds), []
            for _, b in values:
                cum.append(below)
                below += b
            for i in range(step, all_, step):
                while i < all_ and values[i][0] == values[i - 1][0]:
                    i += 1
                if i >= all_:
                    break
                t = (values[i][0] + values[i - 1][0]) / 2
                for at_least, p, n in ((False, cum[i], i), (True, bad - cum[i], all_ - i)):
                    if p and (gain := p * (math.log2(p / n) - was)) > (best[0] if best else 1e-9):
                        best = (gain, (f, at_least, t))
        if best is None:
            break
        conditions += (best[1],)
        f, at_least, t = best[1]
        rows = [r for r in rows if (r[0][f] >= t) == at_least]
    return Rule(conditions)


def _pruned(rule: Rule, rows) -> Rule | None:
    """The prefix of the conjunction that has the best (bad - good) / (bad + good) among pruning rows."""
    best = None
    for k in range(len(rule.conditions), 0, -1):
        r = Rule(rule.conditions[:k])
        hit = [b for x, b in rows if r.holds(x)]
        worth = (2 * sum(hit) - len(hit)) / len(hit) if hit else -1.0
        if best is None or worth > best[0] + 1e-12:
            best = (worth, r)
    return best[1] if best and best[0] > 0 else None


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", bound: int = 12_000) -> DecisionList:
    """The list learned from at most ``bound`` labelled rows (smallest hash of the key), label 0 being bad.

    The labelled ids are broadcast; ``bound`` is their proven limit. Rows that the base rules reject
    don't count. Of labels that disagree about a key, bad counts; of texts that share a key, the least. Without labels
    or documents the list is empty.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_mq_key"), (F.col(label) == 0).alias("_mq_bad")).groupBy("_mq_key").agg(F.bool_or("_mq_bad").alias("_mq_bad"))
    known = sample_by_hash(known, "_mq_key", bound, salt=7)
    seen = docs.select(F.col(key).alias("_mq_key"), F.col(text).alias("_mq_body")).join(F.broadcast(known), "_mq_key")
    seen = seen.groupBy("_mq_key", "_mq_bad").agg(F.min("_mq_body").alias("_mq_body"))
    s = F.col(_STATS)
    rows = with_statistics(seen, "_mq_body").filter(~base_failed(s)).select("_mq_key", "_mq_bad", *[v.alias(k) for k, v in features(s).items()]).collect()
    return learn([({f: float(r[f]) for f in FEATURES}, bool(r["_mq_bad"])) for r in sorted(rows, key=lambda r: (hash_order(r["_mq_key"]), r["_mq_key"]))])


def hash_order(key: int) -> int:
    import zlib

    return zlib.crc32(str(key).encode())


def judge(docs: DataFrame, rules: DecisionList, text: str = "text") -> DataFrame:
    """``docs`` with the statistics as struct ``_mq_stats``, ``_mq_failed`` (base rules), ``_mq_rule`` and ``_mq_kept``."""
    s = F.col(_STATS)
    out = with_statistics(docs, text).withColumn("_mq_failed", base_failed(s)).withColumn("_mq_rule", rules.verdict(s).cast("int"))
    return out.withColumn("_mq_kept", ~F.col("_mq_failed") & (F.col("_mq_rule") == 0))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns only."""
    return judge(docs, fit(docs, labels, text), text).filter("_mq_kept").select(*[F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: the contract's statistics, base_failed, kept, and the number of the rejecting rule."""
    out = judge(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select(
        "doc_id",
        *[F.col(f"{_STATS}.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        F.col("_mq_failed").alias("base_failed"),
        F.col("_mq_kept").alias("kept"),
        F.col("_mq_rule").alias("rule"),
    )
