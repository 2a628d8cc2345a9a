"""Line entropy under an interpolated n-gram model (Jelinek-Mercer smoothing).

p_0 = 1/V, p_j(w | h) = l * c(hw)/c(h) + (1 - l) * p_{j-1}(w | shorter h); an
unseen context falls back to the shorter one. The entropy of a line is the mean
of -log2 p over its words.

Equal lines are scored once and equal n-grams are looked up once; a full n-gram
fixes all its shorter endings, so probabilities are a table with one row per
distinct n-gram of the scored lines.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from diffgauge.functions import text as X
from diffgauge.operators.joins import hot_keys, is_small, salted_lookup
from diffgauge.session import materialize

PAD = "<s>"


def full_grams(words, order: int) -> Column:
    """The n-gram ending at each word of a word array, as an array of arrays.

    The padded words are zipped with their own shifts, so they are built a fixed
    number of times and not once per word.
    """
    words = F.col(words) if isinstance(words, str) else words
    padded = F.concat(F.array_repeat(F.lit(PAD), order - 1), words)
    shifts = [F.slice(padded, F.lit(s + 1), F.size(words)).alias(str(s)) for s in range(order)]
    return F.transform(F.arrays_zip(*shifts), lambda z: F.array(*[z[str(s)] for s in range(order)]))


def exploded_grams(lines: DataFrame, text: str, order: int, keep: Sequence[str] = ()) -> DataFrame:
    worded = lines.select(*keep, X.line_words(text).alias("_words"))
    return worded.select(*keep, F.explode(full_grams("_words", order)).alias("g"))


def corpus_without(corpus: DataFrame, test: DataFrame, text: str = "text") -> DataFrame:
    """Distinct corpus lines that are no (stripped) test line."""
    seen = test.select(X.strip_space(text).alias(text)).distinct()
    return corpus.select(text).distinct().join(seen, text, "left_anti")


def gram_parts(order: int, shortest: int = 0) -> list[Column]:
    """(kind, gram) of an n-gram ``g``: its endings with ``shortest`` words in front at least, and the contexts."""
    parts = [F.struct(F.lit("g").alias("kind"), F.array_join(F.slice("g", order - j, j + 1), " ").alias("gram"))
             for j in range(shortest, order)]
    return parts + [F.struct(F.lit(f"h{j}").alias("kind"), F.array_join(F.slice("g", order - j, j), " ").alias("gram"))
                    for j in range(1, order)]


def gram_counts(train: DataFrame, text: str, order: int) -> DataFrame:
    """(gram, c): counts of the word sequences of length 1..order ending at each
    word, and of the contexts in front of it (kind 'g' and 'h')."""
    grams = exploded_grams(train, text, order).groupBy("g").agg(F.count(F.lit(1)).alias("c"))
    return (grams.select("c", F.explode(F.array(*gram_parts(order))).alias("p"))
            .groupBy("p.kind", "p.gram").agg(F.sum("c").alias("c")))


def asked_counts(train: DataFrame, text: str, order: int, wanted: DataFrame) -> DataFrame:
    """``gram_counts`` of all single words and of the longer sequences and contexts of the ``wanted`` n-grams only.

    The wanted ones are measured: below the bounds of a broadcast they stay where the words are and only what they
    meet is counted, so no n-gram that nobody asks for is shuffled. Beyond them all n-grams are counted.
    """
    asked = materialize(wanted.select(F.explode(F.array(*gram_parts(order, 1))).alias("p")).select("p.kind", "p.gram").distinct())
    if not is_small(asked):
        return gram_counts(train, text, order)
    stored = materialize(train.select(text))        # read for the words and for the sequences
    words = (stored.select(F.explode(X.line_words(text)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("c"))
             .select(F.lit("g").alias("kind"), "gram", "c"))
    longer = (exploded_grams(stored, text, order).select(F.explode(F.array(*gram_parts(order, 1))).alias("p"))
              .select("p.kind", "p.gram").join(F.broadcast(asked), ["kind", "gram"], "left_semi"))
    return words.unionByName(longer.groupBy("kind", "gram").agg(F.count(F.lit(1)).alias("c")))


def gram_entropies(counts: DataFrame, wanted: DataFrame, order: int, weight: float) -> DataFrame:
    """(gram array g, bits) for every wanted full n-gram.

    The number of words and of distinct words, two scalars, enter as literals.
    """
    single = counts.where((F.col("kind") == "g") & ~F.contains("gram", F.lit(" ")))
    total, vocab = single.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)) + 1).first()
    parts = [F.struct(F.lit(j).alias("j"), F.lit("g").alias("kind"),
                      F.array_join(F.slice("g", order - j, j + 1), " ").alias("gram")) for j in range(order)]
    parts += [F.struct(F.lit(j).alias("j"), F.lit(f"h{j}").alias("kind"),
                       F.array_join(F.slice("g", order - j, j), " ").alias("gram")) for j in range(1, order)]
    long = wanted.select("g", F.explode(F.array(*parts)).alias("p")).select("g", "p.j", "p.kind", "p.gram")
    found = salted_lookup(long, counts, ["kind", "gram"])
    per = found.groupBy("g").agg(
        *[F.max(F.when((F.col("kind") == "g") & (F.col("j") == j), F.col("c"))).alias(f"c{j}") for j in range(order)],
        *[F.max(F.when(F.col("kind") == f"h{j}", F.col("c"))).alias(f"h{j}") for j in range(1, order)])
    p = F.lit(1.0 / vocab)
    for j in range(order):
        seen = F.coalesce(F.col(f"h{j}"), F.lit(0)) if j else F.lit(total)
        share = F.try_divide(F.coalesce(F.col(f"c{j}"), F.lit(0)).cast("double"), seen.cast("double"))
        p = F.when(seen > 0, weight * share + (1 - weight) * p).otherwise(p)
    return per.select("g", (-F.log2(p)).alias("bits"))


def line_entropy(train: DataFrame, test: DataFrame, line_id: str = "line_id", text: str = "text",
                 order: int = 3, weight: float = 0.5) -> DataFrame:
    """(line_id, entropy) of every test line; null for a line without words."""
    texts = test.select(text).distinct()
    grams = exploded_grams(texts, text, order, [text]).groupBy(text, "g").agg(F.count(F.lit(1)).alias("n"))
    wanted = grams.select("g").distinct()
    # read twice below, so written once
    counts = materialize(asked_counts(train, text, order, wanted))
    bits = gram_entropies(counts, wanted, order, weight)
    scored = (salted_lookup(grams, bits, ["g"], "inner").groupBy(text)
              .agg((F.sum(F.col("bits") * F.col("n")) / F.sum("n")).alias("entropy")))
    rows = test.select(line_id, text)
    # one boilerplate line may be a large share of all lines: spread its rows
    return salted_lookup(rows, scored, [text], hot=hot_keys(rows, [text])).select(line_id, "entropy")
