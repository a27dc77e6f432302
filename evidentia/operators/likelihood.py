"""How likely candidate answers are, by an n-gram model that is counted from texts and looked up by joins.

The model is a table of n-grams with their counts. A word's likelihood after the words before it is the share of its
n-gram among those of its context; where the n-gram is not known, `BACK_OFF` times that of the next shorter one, down
to the word's share of all words. Candidates look up the counts of their n-grams, of which a bitmap drops most that the
model doesn't have before they are shuffled; an n-gram's context is the n-gram that ends a word earlier, so it needs no
look-up of its own.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BACK_OFF = 0.4
#: Bits of a row of a bitmap of n-grams, which is 512 numbers of 64 bits; most rows, and bits for each n-gram where these
#: are enough. With a few hundred rows more, Spark's table of the broadcast takes 128 MB in place of 64.
_CHUNK, CHUNKS, BITS_PER_GRAM = 1 << 15, 31 << 9, 32
_WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text; a NULL text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_WORD), F.lit(0))


def ngram_model(texts: DataFrame, text: str, order: int = 3, only: DataFrame | None = None) -> DataFrame:
    """(n, gram, count) of all n-grams of 1 to `order` words; the row of n 0 and the empty gram counts all words.

    `only` has a column `gram`: with it the n-grams that it names are kept, counted in all texts; it must name the first
    words of its n-grams too. A bitmap of at most 64 MB, broadcast, drops most others before they are shuffled; the asked
    n-grams then go through the same grouping, which leaves out the rest exactly, and neither side is sorted for a join."""
    each = _text_runs(texts, text, order)
    if only is None:
        each = each.withColumns({f"hit{n}": F.col(f"w{n - 1}").isNotNull() for n in range(1, order + 1)})
        return _with_total(_found(each, [], order).groupBy("gram").agg(F.count("*").alias("count")), texts, text)
    found = _found(_may_be_among(each, _gram_places(only, order), order), [], order).select("gram", F.lit(1).alias("one"))
    both = found.unionByName(only.select("gram", F.lit(0).alias("one")))
    counts = both.groupBy("gram").agg(F.sum("one").alias("count"), F.min("one").alias("least")).where("least = 0 AND count > 0")
    return _with_total(counts, texts, text)


def model_for(texts: DataFrame, text: str, candidates: DataFrame, prompt: str, answer: str, order: int = 3) -> DataFrame:
    """As `ngram_model`, of the n-grams that `candidate_likelihood` looks up, and of others that share a bit with one.

    Of the candidates only bits are shuffled, no n-gram, so that an n-gram travels only if the texts may have it too."""
    asked = _sequence_runs(candidates, [], prompt, answer, order)
    places = asked.select(F.explode(F.array(*[F.when(F.col(f"w{n - 1}").isNotNull(), _hash(n)) for n in range(1, order + 1)])).alias("p")).where("p IS NOT NULL")
    found = _found(_may_be_among(_text_runs(texts, text, order), places, order, all_runs=True), [], order)
    return _with_total(found.groupBy("gram").agg(F.count("*").alias("count")), texts, text)


def _with_total(counts: DataFrame, texts: DataFrame, text: str) -> DataFrame:
    counted = counts.select((F.length("gram") - F.length(F.replace("gram", F.lit(" "), F.lit(""))) + 1).alias("n"), "gram", "count")
    total = texts.select(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(_WORD)).alias("k")).agg(F.coalesce(F.sum("k"), F.lit(0)).cast("bigint").alias("count"))
    return counted.unionByName(total.select(F.lit(0).alias("n"), F.lit("").alias("gram"), "count"))


def _after(order: int) -> list[Column]:
    """Of the words in `w` those from each of the first places on; zipped, each word with those after it, NULL behind the last."""
    return [F.slice("w", k + 1, F.size("w")).alias(f"w{k}") for k in range(order)]


def _text_runs(texts: DataFrame, text: str, order: int) -> DataFrame:
    """(w0, w1, ...): each word of the texts with those after it."""
    after = texts.select(words(F.col(text)).alias("w")).select(*_after(order))
    return after.select(F.explode(F.arrays_zip(*after.columns)).alias("z")).select("z.*")


def _sequences(candidates: DataFrame, keys: Sequence[str], prompt: str, answer: str, order: int) -> DataFrame:
    """(keys, skip, w): the last words of the prompt, `skip` of them, and all of the answer. Both are texts or lists of words."""
    split = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>")) if candidates.schema[c].dataType.typeName() == "array" else words(F.col(c))
    rows = candidates.select(*keys, split(prompt).alias("before"), split(answer).alias("said"))
    tail = F.slice("before", F.greatest(F.size("before") - (order - 2), F.lit(1)), F.lit(order - 1))
    return rows.select(*keys, F.size(tail).alias("skip"), F.concat(tail, "said").alias("w"))


def _sequence_runs(candidates: DataFrame, keys: Sequence[str], prompt: str, answer: str, order: int) -> DataFrame:
    """(keys, at, w0, w1, ...): each word of the sequences with those after it, and its place, 0 being the answer's first word."""
    after = _sequences(candidates, keys, prompt, answer, order).select(*keys, "skip", F.arrays_zip(*_after(order)).alias("z"))
    return after.select(*keys, "skip", F.posexplode("z").alias("i", "r")).select(*keys, (F.col("i") - F.col("skip")).alias("at"), "r.*")


def _found(each: DataFrame, columns: Sequence[str], order: int) -> DataFrame:
    """(columns, n, gram): of each row the n-grams that hit<n> marks."""
    runs = [F.when(F.col(f"hit{n}"), F.struct(F.lit(n).alias("n"), _run(n).alias("gram"))) for n in range(1, order + 1)]
    return each.select(*columns, F.explode(F.array(*runs)).alias("r")).where("r IS NOT NULL").select(*columns, "r.*")


def _run(n: int) -> Column:
    return F.concat_ws(" ", *[f"w{k}" for k in range(n)])


def _hash(n: int) -> Column:
    return F.xxhash64(*[f"w{k}" for k in range(n)])


def _gram_places(grams: DataFrame, order: int) -> DataFrame:
    """(p): a hash of each n-gram, by its words."""
    w = F.split("gram", " ")
    return grams.select(F.xxhash64(*[F.get(w, F.lit(k)) for k in range(order)]).alias("p"))


def _bitmap(places: DataFrame, bits: int) -> DataFrame:
    """(chunk, bits): a bit for each hash p, in chunks of 512 numbers of 64 bits, of which the first byte has the lowest places."""
    place = F.pmod("p", F.lit(bits))
    chunks = places.groupBy(F.shiftright(place, 15).alias("chunk")).agg(F.bitmap_construct_agg(place.bitwiseAND(F.lit(_CHUNK - 1))).alias("b"))
    number = lambda k: F.conv(F.hex(F.substring("b", 8 * k + 1, F.lit(8))), 16, -10).cast("bigint")
    return chunks.select("chunk", F.transform(F.sequence(F.lit(0), F.lit(_CHUNK // 64 - 1)), number).alias("bits"))


def _may_be_among(each: DataFrame, places: DataFrame, order: int, all_runs: bool = False) -> DataFrame:
    """Rows w0, w1, ... with hit<n>, whether their first n words and all shorter runs of first words may be among the
    n-grams of these hashes; rows without a hit go. `all_runs` says that the n-grams have their last words among them too,
    so that one that only shares its bit with another is mostly dropped for a run that is not."""
    bits = _CHUNK * min(BITS_PER_GRAM * places.count() // _CHUNK + 1, CHUNKS)
    bitmap = _bitmap(places, bits)

    def looked_up(each: DataFrame, name: str, run: list[str], if_held: Column) -> DataFrame:
        p = F.when(if_held & F.col(run[-1]).isNotNull(), F.pmod(F.xxhash64(*run), F.lit(bits)))
        each = each.withColumn("p", p).withColumn("chunk", F.shiftright("p", 15)).join(F.broadcast(bitmap), "chunk", "left")
        number = F.get("bits", F.shiftright("p", 6).bitwiseAND(F.lit(_CHUNK // 64 - 1)).cast("int"))
        hit = F.getbit(number, F.col("p").bitwiseAND(F.lit(63)).bitwiseXOR(F.lit(56)).cast("int")) == 1
        return each.withColumn(name, F.coalesce(hit, F.lit(False))).drop("p", "chunk", "bits")

    columns = [f"w{k}" for k in range(order)]
    each = looked_up(each, "hit1", columns[:1], F.lit(True)).where("hit1")
    for n in range(2, order + 1):
        each = looked_up(each, f"hit{n}", columns[:n], F.col(f"hit{n - 1}"))
        if all_runs:
            each = looked_up(each, f"hit{n}", columns[1:n], F.col(f"hit{n}"))
    return each


def asked_grams(candidates: DataFrame, prompt: str, answer: str, order: int = 3) -> DataFrame:
    """(gram): the n-grams that `candidate_likelihood` looks up, each once."""
    each = _sequence_runs(candidates, [], prompt, answer, order)
    each = each.withColumns({f"hit{n}": F.col(f"w{n - 1}").isNotNull() for n in range(1, order + 1)})
    return _found(each, [], order).select("gram").distinct()


def candidate_likelihood(candidates: DataFrame, keys: Sequence[str], prompt: str, answer: str, model: DataFrame, order: int = 3) -> DataFrame:
    """(keys, n_words, score): the mean log likelihood of the answer's words, each after the words before it.

    The first words of an answer come after the last of its prompt. A word that the model does not know counts as one
    occurrence beside all words. An answer without words has the score NULL. `keys` name a candidate. Prompt and answer
    are texts or lists of words."""
    # each word as if the model knew none, and what is to add where it knows the word
    size = lambda k: F.least(k + 1, F.lit(order))
    sequences = _sequences(candidates, keys, prompt, answer, order)
    backed = F.aggregate(F.sequence(F.lit(0), F.lit(order - 1)), F.lit(0), lambda t, k: t + F.when((k >= F.col("skip")) & (k < F.size("w")), size(k) - order).otherwise(0))
    n_words = (F.size("w") - F.col("skip")).cast("bigint")
    base = sequences.select(*keys, n_words.alias("n_words"), (n_words * (order - 1) + backed).alias("backed"))
    total = model.where("n = 0").agg(F.greatest(F.coalesce(F.max("count"), F.lit(0)), F.lit(0)).alias("d1"))
    known = _known_words(_sequence_runs(candidates, keys, prompt, answer, order), keys, model, total, order)
    scored = base.join(known, list(keys), "left").join(F.broadcast(total))
    log_p = -F.col("n_words") * F.log(F.col("d1") + 1) + F.col("backed") * F.log(F.lit(BACK_OFF)) + F.coalesce("more", F.lit(0.0))
    return scored.select(*keys, "n_words", F.when(F.col("n_words") > 0, log_p / F.col("n_words")).alias("score"))


def _known_words(runs: DataFrame, keys: Sequence[str], model: DataFrame, total: DataFrame, order: int) -> DataFrame:
    """(keys, more): the sum, over answer words that the model knows, of their log likelihood above that of a new word in the same place."""
    counts = model.where("n > 0").select("gram", "count")
    asked = _found(_may_be_among(runs, _gram_places(counts, order), order), [*keys, "at"], order)
    # a candidate's rows stand in one task from here on
    hits = asked.join(counts, "gram").select(*keys, (F.col("at") + F.col("n") - 1).alias("end"), "n", "count").repartition(*keys)
    held = [F.max(F.when(F.col("n") == n, F.col("count"))).alias(f"c{n}") for n in range(1, order + 1)]
    places = hits.groupBy(*keys, "end").agg(*held)
    before = F.lag(F.struct("end", *[f"c{n}" for n in range(1, order)])).over(Window.partitionBy(*keys).orderBy("end"))
    places = places.withColumn("before", F.when(before["end"] == F.col("end") - 1, before)).where("end >= 0").join(F.broadcast(total))
    p = reduce(lambda lower, n: F.when(F.col(f"c{n}").isNotNull(), F.log(F.col(f"c{n}") / F.col(f"before.c{n - 1}")) - (n - 1) * F.log(F.lit(BACK_OFF))).otherwise(lower), range(2, order + 1), F.log(F.col("c1") / F.col("d1")))
    return places.groupBy(*keys).agg(F.sum(p + F.log(F.col("d1") + 1)).alias("more"))
