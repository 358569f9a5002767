"""Quality rules with risk-controlled thresholds; DataFrame functions only.

Each rule compares a signal of a text with a cutoff and rejects above it. Cutoffs come from
fixed grids, so the labelled documents are all holdout. The cutoffs of all rules form one fixed path, from the loosest of each rule to
the tightest; after some of its steps, every rule rejects by the tightest of its cutoffs so far. For each stratum (language) the path is
followed by fixed-sequence testing: a step counts as certified if, of the n good documents that pass the base rule, the k that this and the steps
before reject give an exact binomial tail P(X <= k | n, alpha) of at most delta / strata. No step after one that fails is taken, so the
steps need no share of delta; the strata do (Bonferroni), those with enough good documents for any certificate. So with probability
1 - delta no stratum loses more than alpha of its good documents that pass the base rule; what the base rule rejects is fixed by
its own law and isn't counted. A stratum without a certificate rejects by the base rule alone.

Null texts count as empty; null strata are the stratum ''. Repeated rows and null doc_ids are judged row by row. A text's windows lie in one row as an
array of longs (8 bytes a word, more while they are sorted), so a text has to fit a task's memory a few times over. Rows with other columns of
any name keep them. Empty tables give empty results; without labels the base rule alone decides.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, cut, fresh, words, written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
ALPHA = 0.05
DELTA = 0.05
#: Fewer good documents than this can't be certified for anything, even alone.
MIN_GOOD = math.ceil(math.log(DELTA) / math.log1p(-ALPHA))
#: More strata with cutoffs than this are joined instead of broadcast.
BROADCAST_STRATA = 20_000
#: Rejected above; each a share of the words, or of the letters for capitals.
GRIDS: dict[str, list[float]] = {
    "symbol_share": [0.02, 0.05, 0.1, 0.2, 0.4, 0.8],
    "dup_line_share": [0.05, 0.1, 0.2, 0.3, 0.5],
    "repeat_share": [0.1, 0.2, 0.3, 0.4],
    "capital_share": [0.1, 0.15, 0.2, 0.3, 0.5],
}
#: The fixed path: the loosest cutoff of each rule, then the next ones.
PATH: list[tuple[str, float]] = [(r, sorted(cs, reverse=True)[i]) for i in range(max(map(len, GRIDS.values()))) for r, cs in GRIDS.items() if i < len(cs)]
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals"]


def _steps(text: Column) -> list[dict[str, Column]]:
    """Columns from a text to its counts, each step from those before it.

    Hashes of the 3-word windows are sorted as plain longs to see whether any repeats; only
    texts with a repeat sort (hash, place) pairs. Every word that a repeated window covers
    counts once, in the first window too.
    """
    at = lambda c, i: F.get(F.col(c), i)
    zero = F.lit(0).cast("long")
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    same = lambda e, i: e.h.eqNullSafe(at("_z", i).h)
    return [
        {"_t": F.coalesce(text, F.lit(""))},
        {
            "_w": words(F.col("_t")),
            "_l": F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""),
            "n_symbols": (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long"),
            "n_capitals": (F.length("_t") - F.length(F.translate("_t", capitals, ""))).cast("long"),
        },
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_lines": F.size("_l").cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "_h": F.when(
                F.size("_w") >= 3,
                F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.xxhash64(at("_w", i), at("_w", i + 1), at("_w", i + 2))),
            ).otherwise(F.array().cast("array<bigint>")),
        },
        {"_s": F.sort_array("_h")},
        {"_again": F.coalesce(F.exists(F.sequence(F.lit(1), F.greatest(F.size("_s") - 1, F.lit(1))), lambda i: at("_s", i) == at("_s", i - 1)), F.lit(False))},
        {"_z": F.when(F.col("_again"), F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))},
        {"_p": F.sort_array(F.transform(F.filter("_z", lambda e, i: same(e, i - 1) | same(e, i + 1)), lambda e: e.i))},
        {
            "n_repeat_words": F.coalesce(
                F.aggregate(F.transform("_p", lambda p, i: F.least(F.lit(3), F.coalesce(at("_p", i + 1) - p, F.lit(3)))), zero, lambda a, x: a + x),
                zero,
            )
        },
    ]


def quality_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row for each row of docs: ``row`` (the row as it came), the counts of its text and
    ``base_failed``. Null and empty texts have no words, so they fail the base rule."""
    out = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    for step in _steps(F.col(f"row.`{text}`")):
        out = out.withColumns(step)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    # a generator of one row: filters on the counts aren't pushed below it, where each use would count again
    return out.select(F.inline(F.array(F.struct("row", *BASE, failed.alias("base_failed")))))


def _signals() -> dict[str, Column]:
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {
        "symbol_share": share("n_symbols", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "capital_share": share("n_capitals", "word_chars"),
    }


def first_step(path: list[tuple[str, float]] = PATH) -> Column:
    """The first step of the path that rejects a row, by its counts; the path's length if none does."""
    sig = _signals()
    return F.coalesce(*[F.when(sig[r] > c, F.lit(i)) for i, (r, c) in enumerate(path)], F.lit(len(path)))


def certified_steps(good: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA, path: list[tuple[str, float]] = PATH) -> DataFrame:
    """stratum, n, most (of n that may be rejected; -1: nothing certified) and steps, how many steps of the path hold.

    good: one row for each labelled good document that passes the base rule (copies once, they aren't
    independent), with ``stratum`` and the counts. Strata of fewer than MIN_GOOD rows aren't tested. Without good rows, no strata.
    """
    rows = good.select(F.coalesce(F.col(stratum), F.lit("")).alias("stratum"), first_step(path).alias("first"))
    at = [F.sum((F.col("first") <= i).cast("long")).alias(f"k{i}") for i in range(len(path))]
    per = cut(rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *at).filter(F.col("n") >= MIN_GOOD))
    level = math.log(delta / max(1, per.count()))
    state = lambda lt, ls, best: F.struct(lt.alias("lt"), ls.alias("ls"), best.alias("best"))

    def more(a: Column, i: Column) -> Column:
        lt = a.lt + F.log((F.col("n") - i + 1) / i) + math.log(alpha / (1 - alpha))
        top = F.greatest(lt, a.ls)
        ls = top + F.log1p(F.exp(F.least(lt, a.ls) - top))
        return state(lt, ls, F.when(ls <= level, i).otherwise(a.best))

    none = F.col("n") * math.log1p(-alpha)
    most = F.aggregate(
        F.sequence(F.lit(1).cast("long"), F.greatest((F.col("n") * alpha).cast("long"), F.lit(1).cast("long"))),
        state(none, none, F.when(none <= level, F.lit(0).cast("long")).otherwise(F.lit(-1).cast("long"))),
        more,
        lambda a: a.best,
    )
    # counts rise along the path, so the steps that hold are the first ones
    holds = F.array(*[F.col(f"k{i}") <= F.col("most") for i in range(len(path))])
    return per.withColumn("most", most).select("stratum", "n", "most", F.size(F.filter(holds, lambda h: h)).alias("steps"))


def apply_steps(counted: DataFrame, certified: DataFrame, stratum: Column, path: list[tuple[str, float]] = PATH) -> DataFrame:
    """counted with ``kept``: false if the base rule or a certified step of its stratum rejects the row.
    The table of strata can have any size."""
    taken = counted.columns
    key, own = (fresh(n, taken) for n in ("_stratum", "_steps"))
    some = certified.filter("steps > 0").select(F.col("stratum").alias(key), F.col("steps").alias(own))
    few = some.limit(BROADCAST_STRATA + 1).count() <= BROADCAST_STRATA
    out = counted.withColumn(key, F.coalesce(stratum, F.lit(""))).join(F.broadcast(some) if few else some, key, "left")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(first_step(path) < F.col(own), F.lit(False))).drop(key, own)


def good_documents(counted: DataFrame, labels: DataFrame, key: str = "doc_id", stratum: str = "lang") -> DataFrame:
    """Counts of the distinct texts of each stratum that pass the base rule and whose documents all labels call good (quality 1, not toxic)."""
    ok = labels.groupBy(F.col("doc_id").alias("_id")).agg((F.min(F.coalesce("quality", F.lit(0))) >= 1).alias("_good"), F.max(F.coalesce("toxic", F.lit(0))).alias("_toxic")).filter("_good and _toxic = 0")
    rows = counted.filter("not base_failed").select(F.col(key).alias("_id"), "text_hash", F.coalesce(F.col(stratum), F.lit("")).alias("lang"), *BASE)
    return rows.join(ok, "_id", "left_semi").groupBy("text_hash", "lang").agg(*[F.first(c).alias(c) for c in BASE])


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept for every row of docs.

    Rows are counted once and held in the shared folder without their texts; labelled good
    ones set the cutoffs. Repeated and null doc_ids stay as rows of their own.
    """
    c = quality_counts(docs)
    c = cut(c.select(F.col("row.doc_id").alias("doc_id"), F.col("row.lang").alias("lang"), F.xxhash64("row.text").alias("text_hash"), *BASE, "base_failed"))
    return apply_steps(c, certified_steps(good_documents(c, labels)), F.col("lang"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that pass, with the columns of docs.

    Counts are taken once and held beside the rows, so that texts are neither counted again nor shuffled.
    """
    c = quality_counts(docs)
    held = written(c.select("row", F.col("row.doc_id").alias("doc_id"), F.col("row.lang").alias("lang"), F.xxhash64("row.text").alias("text_hash"), *BASE, "base_failed"))
    certified = cut(certified_steps(good_documents(held, labels)))
    return apply_steps(held, certified, F.col("lang")).filter("kept").select("row.*")
