"""Quality rules: divergence of a text's histograms from language references.

Two histograms of every whole text are compared with those of each reference
language by Jensen-Shannon distance (the root of the base-2 divergence, 0 to
1): the shares of seven character classes, and the shares of the language's
commonest words among all words.  The nearest language decides.  The listed
words are a fifth or a quarter of all words, so a text with none of them is
only 0.30 to 0.39 away, by language: word distances are limited as shares of
that one (``Limits``).  Guards keep short texts, whose histograms say little,
from being judged.  Only DataFrame functions run; every value of a row comes
from that row, so nothing shuffles.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2, sqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SPACE, read, renamed, text_or_empty

#: Fixed values.  Share of characters by class in ordinary prose: lower-case
#: a-z, upper-case A-Z, other letters, digits, white space, sentence marks, rest.
CLASS_SHARES = {
    "de": [0.790, 0.040, 0.020, 0.003, 0.125, 0.021, 0.001],
    "en": [0.790, 0.025, 0.001, 0.003, 0.160, 0.020, 0.001],
    "es": [0.780, 0.025, 0.025, 0.003, 0.145, 0.021, 0.001],
    "fr": [0.770, 0.025, 0.035, 0.003, 0.145, 0.021, 0.001],
}
#: Fixed values.  Share of words in ordinary prose, in percent.
WORD_SHARES = {
    "de": {"der": 3.2, "die": 3.1, "und": 2.8, "in": 1.8, "den": 1.3, "von": 1.1, "zu": 1.1, "das": 1.0,
           "mit": 0.9, "ist": 0.9},
    "en": {"the": 6.0, "of": 3.3, "and": 2.8, "to": 2.6, "in": 2.1, "a": 2.1, "is": 1.1, "that": 1.0,
           "for": 0.9, "was": 0.8},
    "es": {"de": 6.2, "la": 4.0, "que": 3.1, "el": 2.9, "en": 2.7, "y": 2.5, "a": 2.1, "los": 1.7, "se": 1.2,
           "del": 1.2},
    "fr": {"de": 5.0, "la": 3.0, "le": 2.5, "et": 2.2, "les": 2.0, "des": 1.8, "en": 1.5, "un": 1.2, "une": 1.1,
           "que": 1.0},
}


@dataclass(frozen=True)
class Limits:
    """The rule's parameters: greatest distances, and the guards below which none is judged.

    ``word_distance`` is a share of the word distance that a text with no
    common word has from the same language.  ``both`` limits the sum of that
    share and the class distance as a share of its own limit, for texts that
    are close to both limits.
    """

    class_distance: float = 0.30
    word_distance: float = 0.90
    both: float = 1.40
    min_chars: int = 200
    min_words: int = 50


def _with_next(hashes: Column, width: int):
    """A hash together with the one ``width`` places on."""
    return lambda h, i: F.xxhash64(h, F.get(hashes, i + width))


def _count(words: Column, word: str) -> Column:
    return F.size(F.filter(words, lambda v: v == word))


def _part(x: Column, y: Column) -> Column:
    """What share x adds to twice the divergence, y being the other side's share."""
    return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)


def _distance(p: Column, q: list[float]) -> Column:
    """Jensen-Shannon distance of a row's array of shares from fixed ones."""
    parts = F.zip_with(p, F.array(*map(F.lit, q)), lambda x, y: _part(x, y) + _part(y, x))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda a, v: a + v) / 2))


def _no_word_distance(shares: dict[str, float]) -> float:
    """Word distance of a text with none of a language's common words (shares in percent)."""
    listed = sum(shares.values()) / 100
    rest = max(0.0, 1 - listed)
    # the listed words add their share; all words of the text stand against the others
    return sqrt((listed + log2(2 / (1 + rest)) + (rest and rest * log2(2 * rest / (1 + rest)))) / 2)


def quality(df: DataFrame, text_col: str = "text", class_shares: dict = CLASS_SHARES,
            word_shares: dict = WORD_SHARES, limits: Limits = Limits(), carry: list[str] | None = None) -> DataFrame:
    """Counts, distances and verdict of every row, in its own columns beside ``carry`` (default: all of df's).

    Null texts count as empty: no words, base rule failed.  Repeated rows are
    each judged; an empty table gives an empty result; columns of ``df`` that
    bear an output's name give way to it.  Columns added: ``n_words``,
    ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``,
    ``base_failed``, ``class_distance``, ``word_distance`` (null if a guard
    holds), ``language`` (the nearest by the sum of both), ``kept``.
    """
    out = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
           "class_distance", "word_distance", "language", "kept"]
    carry = [c for c in (df.columns if carry is None else carry) if c.lower() not in out]
    own = [F.col(f"`{c}`") for c in carry]
    x = renamed(df, ["t", "w", "h", "l", "r", "d", "s", "p", "c", "n", "g", *[f"r{i}" for i in range(7)]])
    col = {k: F.col(f"`{v}`") for k, v in x.items()}

    def step(d: DataFrame, keep: list[str], /, **new: Column) -> DataFrame:
        return d.select(*own, *[col[k] for k in keep], *[v.alias(x.get(k, k)) for k, v in new.items()])

    d = df.select(*own, text_or_empty(text_col).alias(x["t"]))
    languages = sorted(class_shares)
    common = sorted({w for s in word_shares.values() for w in s})
    d = step(d, ["t"], w=F.array_remove(F.split(col["t"], SPACE + "+"), ""),
             l=F.filter(F.split(col["t"], "\n"), lambda v: v.rlike(r"[^\x20\x09-\x0D]")))
    # white space and a-z are most of a text: the other classes are counted on
    # what is left, by taking out one class after another
    capital = [v for w in common for v in (w, w.capitalize())]
    d = step(d, ["w", "l"], t=F.length(col["t"]), n=F.size(col["w"]).cast("long"),
             h=F.transform(col["w"], lambda w: F.xxhash64(w)), s=F.length(F.array_join(col["w"], "")).cast("long"),
             c=F.transform(F.filter(col["w"], lambda w: w.isin(capital)), lambda w: F.lower(w)),
             r0=F.array_join(F.regexp_extract_all(col["t"], F.lit("[^a-z ]+"), 0), ""))
    keep = ["t", "n", "s", "c", "r0"]
    left = [SPACE + "+", "[A-Z]+", r"[^\P{L}A-Za-z]+", "[0-9]+", r"[.,;:!?'\"()\-]+"]
    d = step(d, [*keep, "h"], d=F.size(col["l"]) - F.size(F.array_distinct(col["l"])),
             r1=F.regexp_replace(col["r0"], left[0], ""))
    keep = ["t", "n", "s", "c", "d", "r1"]
    # a window of eight words by its hash: of two, of four, then of eight words
    for i, width in enumerate((1, 2, 4), 2):
        d = step(d, keep, h=F.transform(col["h"], _with_next(col["h"], width)),
                 **{f"r{i}": F.regexp_replace(col[f"r{i - 1}"], left[i - 1], "")})
        keep.append(f"r{i}")
    d = step(d, keep, h=F.when(col["n"] >= 8, F.slice(col["h"], 1, F.greatest(F.lit(1), col["n"].cast("int") - 7))),
             r5=F.regexp_replace(col["r4"], left[4], ""))
    keep.append("r5")
    d = step(d, keep, r=F.when(
        F.size(F.array_distinct(col["h"])) < F.size(col["h"]),
        F.sort_array(F.transform(col["h"], lambda v, i: F.struct(v.alias("h"), i.alias("i"))))))
    r = col["r"]
    d = step(d, keep, p=F.sort_array(F.transform(F.filter(
        r, lambda v, i: (F.get(r, i - 1)["h"] == v["h"]) | (F.get(r, i + 1)["h"] == v["h"])), lambda v: v["i"])))
    p = col["p"]
    chars = F.greatest(F.lit(1), col["t"])
    sizes = [col["s"], *[F.length(col[f"r{i}"]) for i in range(1, 6)]]
    counts = [a - b for a, b in zip(sizes, sizes[1:])]  # a-z, A-Z, other letters, digits, marks
    d = step(
        d, ["n", "t"],
        word_chars=col["s"],
        n_symbols=(F.length(col["r5"]) - F.length(F.regexp_replace(col["r5"], r"[#*$%&|<>]+", ""))).cast("long"),
        n_dup_lines=col["d"].cast("long"),
        n_repeat_words=F.coalesce(F.aggregate(
            F.transform(p, lambda v, i: F.least(F.lit(8), F.coalesce(F.get(p, i + 1) - v, F.lit(8)))),
            F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long"),
        d=F.array(*[v / chars for v in (*counts[:4], col["t"] - col["s"], counts[4], sizes[-1])]),
        g=F.array(*[_count(col["c"], w) / F.greatest(F.lit(1), col["n"]) for w in common]))
    numbers = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    # one histogram a language: its common words, and all the others
    hists = [F.array(*[col["g"][common.index(w)] for w in word_shares[name]]) for name in languages]
    d = step(d, ["n", "t", "d"], **{k: F.col(k) for k in numbers[1:]}, g=F.array(*hists))
    both = [F.struct(
        _distance(col["d"], class_shares[name]).alias("class"),
        _distance(F.concat(col["g"][i], F.array(F.greatest(F.lit(0.0), F.lit(1.0) - F.aggregate(
            col["g"][i], F.lit(0.0), lambda a, v: a + v)))),
            [v / 100 for v in word_shares[name].values()] + [1 - sum(word_shares[name].values()) / 100]).alias("word"),
        F.lit(name).alias("language"), F.lit(_no_word_distance(word_shares[name])).alias("none"))
        for i, name in enumerate(languages)]
    d = d.select(*own, col["n"].alias("n_words"), *numbers[1:], col["t"], F.array(*both).alias(x["g"]))
    near = F.array_min(F.transform(col["g"], lambda v: F.struct(
        (v["class"] + v["word"]).alias("sum"), v["class"], v["word"], v["language"], v["none"])))
    d = d.select(*own, *numbers, col["t"], near.alias(x["g"]),
                 ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"))
    d = d.select(
        *own, *numbers, "base_failed",
        F.when(col["t"] >= limits.min_chars, col["g"]["class"]).alias("class_distance"),
        F.when(F.col("n_words") >= limits.min_words, col["g"]["word"]).alias("word_distance"),
        F.when((col["t"] >= limits.min_chars) | (F.col("n_words") >= limits.min_words),
               col["g"]["language"]).alias("language"), col["g"]["none"].alias(x["g"]))
    by_class = F.coalesce("class_distance", F.lit(0.0))
    by_word = F.coalesce("word_distance", F.lit(0.0))
    return d.select(*own, *numbers, "base_failed", "class_distance", "word_distance", "language",
                    (~F.col("base_failed") & (by_class <= limits.class_distance) & (by_word <= limits.word_distance * col["g"])
                     & (by_class * col["g"] + by_word * limits.class_distance
                        <= limits.both * limits.class_distance * col["g"])).alias("kept"))


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep, in the columns of ``docs``."""
    x = renamed(docs, ["own", "row"])
    whole = docs.select(F.struct("*").alias(x["own"]), text_or_empty().alias("text"))
    judged = quality(whole, carry=[x["own"]], **options)
    # a row number in the same projection keeps Spark from pushing the filter
    # down, which would work out every count once more
    judged = judged.select(F.col(x["own"]), "kept", F.monotonically_increasing_id().alias(x["row"]))
    return judged.where(F.col("kept") & (F.col(x["row"]) >= 0)).select(f"{x['own']}.*")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules over every whole text of ``documents``."""
    return quality(read(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
