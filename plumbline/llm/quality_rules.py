"""Quality rules: an ordered decision list learned by sequential covering, applied as one CASE expression.

Everything runs as DataFrame operations.  The driver only sees counts: each growing step asks Spark for the covered
good and bad documents of every threshold and picks the best one.
"""
from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import let
from plumbline.llm.common import occurrences, pick, stage

SPACE = r"\x20\x09-\x0D"
TRIMMED = "\x20\t\n\x0b\x0c\r"
SHARES = (0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.5, 2.0, 3.0)
#: Statistic of a rule, its expression over the counts, and the thresholds tried.
FEATURES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols_per_word": ("try_divide(n_symbols, n_words)", SHARES),
    "marks_per_word": ("try_divide(n_marks, n_words)", SHARES),
    "upper_share": ("try_divide(n_upper, word_chars)", SHARES[:13]),
    "repeat_share": ("try_divide(n_repeat_words, n_words)", SHARES[:13]),
    "same_next_share": ("try_divide(n_same_next, n_words)", SHARES[:13]),
    "dup_line_share": ("try_divide(n_dup_lines, n_lines)", SHARES[:13]),
    "word_length": ("try_divide(word_chars, n_words)", (2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20)),
    "words": ("cast(n_words as double)", (20, 50, 100, 200, 500, 1000, 2000, 5000, 10000)),
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
COUNTS = BASE + ("n_lines", "n_marks", "n_upper", "n_same_next")


@dataclass(frozen=True)
class Rule:
    """Reject a document for which all (feature, bin, at least?) conditions hold."""
    conditions: tuple[tuple[str, int, bool], ...]

    def on_bins(self) -> Column:
        out = F.lit(True)
        for feature, at, above in self.conditions:
            out = out & ((F.col(f"bin_{feature}") >= at) if above else (F.col(f"bin_{feature}") < at))
        return out

    def on_statistics(self) -> Column:
        out = F.lit(True)
        for feature, at, above in self.conditions:
            expr, cuts = FEATURES[feature]
            value, cut = F.coalesce(F.expr(expr), F.lit(0.0)), F.lit(float(cuts[at - 1]))
            out = out & ((value >= cut) if above else (value < cut))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{f} {'>=' if above else '<'} {FEATURES[f][1][at - 1]:g}" for f, at, above in self.conditions)


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows found twice or more: windows are hashed to 64 bits; a text without a repeated hash
    is done after one hash set, others sort (hash, position) and measure the union of the covered positions."""
    grams = F.when(F.size(words) >= 3, F.transform(
        F.sequence(F.lit(1), F.size(words) - 2),
        lambda i: F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)))).otherwise(F.array().cast("array<bigint>"))

    def covered(g: Column) -> Column:
        ranked = F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        hits = let(ranked, lambda r: F.array_sort(F.filter(
            F.transform(r, lambda x, k: F.when((F.get(r, k - 1)["h"] == x["h"]) | (F.get(r, k + 1)["h"] == x["h"]), x["i"])),
            lambda p: p.isNotNull())))
        return let(hits, lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))),
            F.lit(0), lambda acc, x: acc + x))

    return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """The counts of COUNTS beside the given columns, over whole texts; a null text counts as empty."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    trimmed = F.expr("trim(BOTH '" + TRIMMED.replace("\\", "\\\\") + "' FROM coalesce(`" + text + "`, ''))")
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE}]+"))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    n_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    of_words = let(words, lambda w: F.struct(
        F.size(w).alias("n_words"), _repeat_words(w).alias("n_repeat_words"),
        F.size(F.filter(F.transform(w, lambda x, k: F.get(w, k - 1) == x), lambda same: same)).alias("n_same_next")))
    out = docs.select("*", of_words.alias("_w"), n_lines.alias("_l"),
                      F.length(F.regexp_replace(t, f"[{SPACE}]+", "")).cast("long").alias("word_chars"),
                      occurrences(t, r"#*$%&|<>").cast("long").alias("n_symbols"),
                      occurrences(t, r"!?").cast("long").alias("n_marks"),
                      occurrences(t, r"\p{Lu}").cast("long").alias("n_upper"))
    return out.select(*[c for c in out.columns if c not in ("_w", "_l")],
                      *[F.col(f"_w.{c}").cast("long").alias(c) for c in ("n_words", "n_repeat_words", "n_same_next")],
                      F.col("_l.n").cast("long").alias("n_lines"), F.col("_l.d").cast("long").alias("n_dup_lines"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _binned(stats: DataFrame) -> DataFrame:
    def bin_of(expr: str, cuts: tuple[float, ...]) -> Column:
        value = F.coalesce(F.expr(expr), F.lit(0.0))
        return sum((F.when(value >= float(c), 1).otherwise(0) for c in cuts), F.lit(0))

    return stats.select("bad", "prune", *[bin_of(*spec).alias(f"bin_{name}") for name, spec in FEATURES.items()])


def _counts(rows: DataFrame) -> dict[tuple[str, int], tuple[int, int]]:
    """(bad, good) documents by feature and bin: one row per feature and bin comes to the driver."""
    names = list(FEATURES)
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("f"), F.col(f"bin_{n}").alias("b")) for n in names])).alias("c")
    found = (rows.select("bad", cells).groupBy("c.f", "c.b")
             .agg(F.sum(F.col("bad").cast("long")).alias("p"), F.sum((~F.col("bad")).cast("long")).alias("n")).collect())
    return {(r["f"], r["b"]): (r["p"], r["n"]) for r in found}


def _best(counts: dict, had: tuple[int, int], least: int) -> tuple[tuple[str, int, bool], int, int] | None:
    """Condition with the highest information gain (FOIL) over the rows covered so far.  Thresholds of one feature that
    part the rows alike tie: the middle one is taken, which leaves room on both sides; else the first feature wins."""
    ties, top = [], 0.0
    before = log2(had[0] / (had[0] + had[1]))
    for name, (_, cuts) in FEATURES.items():
        p_below = n_below = 0
        for at in range(1, len(cuts) + 1):
            p, n = counts.get((name, at - 1), (0, 0))
            p_below, n_below = p_below + p, n_below + n
            for above, p, n in ((True, had[0] - p_below, had[1] - n_below), (False, p_below, n_below)):
                if p >= least and p + n < had[0] + had[1]:
                    gain = p * (log2(p / (p + n)) - before)
                    if gain > top + 1e-9:
                        ties, top = [((name, at, above), p, n)], gain
                    elif ties and gain > top - 1e-9 and ties[0][0][::2] == (name, above) and ties[0][1:] == (p, n):
                        ties.append(((name, at, above), p, n))
    return ties[len(ties) // 2] if ties else None


def learn(labelled: DataFrame, max_rules: int = 8, max_conditions: int = 4, least_covered: int = 3,
          least_precision: float = 0.9) -> list[Rule]:
    """Ordered reject rules from statistics with a boolean ``bad`` and ``prune`` (rows held back for pruning).

    Grows one conjunction at a time on the growing rows, drops its last conditions while that helps on the pruning rows,
    keeps it if enough of what it rejects there is bad, removes what it covers and goes on.  All labelled rows count.
    """
    rows = stage(_binned(labelled), "rule-bins")
    rules: list[Rule] = []
    while len(rules) < max_rules:
        left = rows
        for r in rules:
            left = left.where(~r.on_bins())
        grow, conditions, had = left.where(~F.col("prune")), (), None
        while len(conditions) < max_conditions:
            counts = _counts(grow.where(Rule(conditions).on_bins()))
            if had is None:
                first = next(iter(FEATURES))
                had = tuple(sum(v[i] for (f, _), v in counts.items() if f == first) for i in (0, 1))
            if had[0] < least_covered or had[1] == 0:
                break
            found = _best(counts, had, least_covered)
            if found is None:
                break
            conditions, had = conditions + (found[0],), found[1:]
        if not conditions:
            break
        tries = [Rule(conditions[:k]) for k in range(len(conditions), 0, -1)]
        on = left.where(F.col("prune")).agg(*[F.coalesce(F.sum((r.on_bins() & (F.col("bad") == want)).cast("long")), F.lit(0))
                                              .alias(f"c{i}{want}") for i, r in enumerate(tries) for want in (True, False)]).first()
        worth = [(on[f"c{i}True"] - on[f"c{i}False"]) / max(1, on[f"c{i}True"] + on[f"c{i}False"]) for i in range(len(tries))]
        at = max(range(len(tries)), key=lambda i: (worth[i], -i))
        hit, miss = on[f"c{at}True"], on[f"c{at}False"]
        if hit == 0 or hit < least_precision * (hit + miss):
            break
        rules.append(tries[at])
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one conditional expression: index of the first rule that holds, null if none does."""
    out = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules))):
        out = F.when(rule.on_statistics(), F.lit(i)).otherwise(out)
    return out


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality",
          row: str | None = None, **learning) -> DataFrame:
    """Statistics and verdict of every row of ``docs`` (doc_id, the counts, base_failed, rule, kept).

    Null and empty texts have no words and fail the base rule.  Repeated rows are judged each; a document with several
    labels counts as bad if any says 0; null labels and labels without a document are ignored.  Without labelled rows
    the list is empty and only the base rule rejects.  ``rule`` is the text of the rejecting rule, null if none.
    A column named by ``row`` is handed on: it tells rows apart that doc_id does not.
    """
    own = [row] if row else []
    picked = pick(docs, doc_id=doc_id, _text=text, **{c: c for c in own})
    stats = stage(text_statistics(picked, "_text").select("doc_id", *own, *COUNTS), "statistics")
    marks = (pick(labels, doc_id=doc_id, quality=quality).where("doc_id is not null and quality is not null")
             .groupBy("doc_id").agg((F.min("quality") == 0).alias("bad")))
    rules = learn(stats.join(marks, "doc_id").withColumn("prune", F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0)
                  .where(~base_failed()), **learning)
    names = F.array(*[F.lit(str(r)) for r in rules]) if rules else F.array().cast("array<string>")
    return (stats.withColumn("_rule", verdict(rules)).withColumn("base_failed", base_failed())
            .select("doc_id", *own, *BASE, "base_failed", (~F.col("base_failed") & F.col("_rule").isNull()).alias("kept"),
                    F.get(names, F.col("_rule")).alias("rule"), *[c for c in COUNTS if c not in BASE]))
