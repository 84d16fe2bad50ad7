"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model predicts bytes from the bytes before them.  N-gram counts of all
trusted documents but those held out are sharded by n-gram; lower orders'
continuation counts, the discounts (from counts of counts) and the
interpolation weights come from groupings and joins of those shards.  Distinct
n-grams of bytes grow far slower than the text: as long as the finished model
is small enough it is broadcast, and every whole document is scored in one map
without a shuffle; a larger one stays in its shards, which the documents'
n-grams meet in joins.  Documents above their language's quantile of the
perplexity of all trusted documents that were not trained on are rejected.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm import _text
from tidepool.operators.components import salted_join
from tidepool.plans.lineage import cut, release

U = np.uint64


@dataclass(frozen=True)
class Model:
    """All trusted documents that are not held out are learnt from, unless ``train_rows`` per language and ``train_bytes`` in all say otherwise.

    A text's mean log probability is drawn towards its language's by
    ``prior_bytes`` bytes' worth, so that a few words do not condemn a text.
    ``quantile`` of trusted texts and ``margin`` (a factor) set the threshold; that of
    all languages is mixed into a language's own for ``prior_rows`` trusted texts.
    """

    order: int = 5
    train_rows: int | None = None
    train_bytes: int | None = None
    prior_bytes: int = 120
    quantile: float = 0.998
    margin: float = 1.05
    prior_rows: int = 100
    #: One in so many trusted documents is never trained on; with those beyond any bounds they set the threshold.
    held_one_in: int = 4
    #: Rows of a model that are sent to the tasks, and numbers of its dense form there, at most.
    most_rows: int = 12_000_000
    most_cells: int = 64_000_000


def _grams(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """Packed n-grams (a byte each, last byte lowest) ending at every byte; rows start after newlines."""
    rows = len(offsets) - 1
    padded = np.full(len(data) + rows * (order - 1), 10, np.uint8)
    at = np.arange(len(data)) + np.repeat(np.arange(1, rows + 1) * (order - 1), np.diff(offsets))
    padded[at] = data
    key = np.zeros(len(data), U)
    for k in range(order - 1, -1, -1):
        key = (key << U(8)) | padded[at - k].astype(U)
    return key


def _count_batches(batches: Iterable[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = _text.utf8(batch.column("text"))
        row = 0
        while row < len(offsets) - 1:
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + (1 << 22), "right")) - 1)
            keys, n = np.unique(_grams(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row], order), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["gram", "n"])
            row = end


def _asked_batches(batches: Iterable[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """The n-grams of every text, and how often it has each."""
    for batch in batches:
        data, offsets = _text.utf8(batch.column("text"))
        for row in range(batch.num_rows):
            own = data[offsets[row] : offsets[row + 1]]
            keys, n = np.unique(_grams(own, np.array([0, len(own)]), order), return_counts=True)
            if len(keys):
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column("text_id")[row], len(keys)), pa.array(keys.view(np.int64)), pa.array(n)], names=["text_id", "gram", "n"])


def kneser_ney(counts: DataFrame, order: int) -> DataFrame:
    """From (gram, n) of the highest order: (k, gram, p, backoff, is_context).

    Rows with is_context false give the interpolated probability ``p`` of a
    k-gram's last byte after the bytes before it; rows with it true the weight
    ``backoff`` that a context of k bytes leaves to shorter ones.
    """
    # All orders take each step in one query: the driver plans and remembers a few of them, not a few for each order.
    bits = [(1 << 8 * k) - 1 for k in range(order + 1)]

    def ending(k: Column) -> Column:
        """The last k bytes of a gram."""
        return F.col("gram").bitwiseAND(F.element_at(F.array(*(F.lit(b) for b in bits)), k + 1))

    # A shorter gram counts the distinct bytes before it.
    longer = counts.select(F.explode(F.sequence(F.lit(1), F.lit(order - 1))).alias("k"), "gram") if order > 1 else None
    shorter = longer and longer.select("k", ending(F.col("k") + 1).alias("gram")).distinct().groupBy("k", ending(F.col("k")).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.select(F.lit(order).alias("k"), "gram", "n")
    grams = cut((top.unionByName(shorter) if shorter else top).withColumn("context", F.when(F.col("k") > 1, F.shiftright("gram", 8)).otherwise(F.lit(0).cast("long"))))
    stats = {r["k"]: r.asDict() for r in grams.groupBy("k").agg(*(F.sum((F.col("n") == i).cast("long")).alias(f"n{i}") for i in (1, 2, 3, 4))).collect()}
    discounts = []
    for k in range(1, order + 1):
        n1, n2, n3, n4 = (max(1, stats.get(k, {}).get(f"n{i}") or 0) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        discounts.append([min(i, max(0.05, i - (i + 1) * y * b / a)) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))])
    # For counts of one, two, and three or more.
    d1, d2, d3 = (F.element_at(F.array(*(F.lit(d[i]) for d in discounts)), F.col("k")) for i in range(3))
    once, twice = (F.sum((F.col("n") == i).cast("long")) for i in (1, 2))
    left = d1 * F.col("once") + d2 * F.col("twice") + d3 * (F.col("all") - F.col("once") - F.col("twice"))
    contexts = grams.groupBy("k", "context").agg(F.sum("n").alias("total"), once.alias("once"), twice.alias("twice"), F.count(F.lit(1)).alias("all"))
    contexts = cut(contexts.select("k", "context", "total", (left / F.col("total")).alias("backoff")))
    discount = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
    terms = cut(grams.join(contexts, ["k", "context"]).select("k", "gram", ((F.col("n") - discount) / F.col("total")).alias("own"), "backoff"))
    release(grams)
    out = [contexts.select((F.col("k") - 1).alias("k"), F.col("context").alias("gram"), F.lit(None).cast("double").alias("p"), "backoff", F.lit(True).alias("is_context"))]
    below = None
    for k in range(1, order + 1):
        done = terms.filter(F.col("k") == k)
        if below is None:
            done = done.withColumn("p", F.col("own") + F.col("backoff") / 257)
        else:
            done = done.withColumn("short", F.col("gram").bitwiseAND(F.lit(bits[k - 1]))).join(below.select(F.col("gram").alias("short"), F.col("p").alias("p_short")), "short")
            done = done.withColumn("p", F.col("own") + F.col("backoff") * F.col("p_short"))
        below = cut(done.select("gram", "p"))
        out.append(below.select(F.lit(k).alias("k"), "gram", "p", F.lit(None).cast("double").alias("backoff"), F.lit(False).alias("is_context")))
    release(terms)
    result = out[0]
    for part in out[1:]:
        result = result.union(part)
    return result


class _Scorer:
    """Dense next-byte distributions of every known context, read through the contexts' trie.

    Known contexts are closed under prefixes and suffixes, because every byte
    of the sample ends one of each length.
    """

    def __init__(self, model: dict[str, np.ndarray], order: int) -> None:
        self.order = order
        k, gram, is_context = model["k"], model["gram"].view(U), model["is_context"]
        # Texts start behind newlines, which the sample itself may not hold.
        letters = np.unique(np.append(gram[(k == 1) & ~is_context].astype(np.int64), 10))
        self.size = len(letters) + 1
        self.symbol = np.zeros(256, np.int32)
        self.symbol[letters] = np.arange(1, self.size)
        ids = [np.sort(gram[(k == n) & is_context]) for n in range(order)]
        self.starts = np.concatenate([[0], np.cumsum([len(c) for c in ids])])
        # (number of the context without its newest byte, newest byte) -> number of the context; from 1, 0 is unknown.
        self.next = []
        for n in range(1, order):
            dense = np.zeros((len(ids[n - 1]) + 1, self.size), np.int32)
            number = np.searchsorted(ids[n - 1], ids[n] >> U(8)) + 1
            dense[number, self.symbol[(ids[n] & U(255)).astype(np.int64)]] = np.arange(1, len(ids[n]) + 1)
            dense[:, 0] = 0
            self.next.append(dense.ravel())
        table = np.empty((self.starts[-1], self.size), np.float32)
        for n in range(order):
            rows, chosen, back = slice(self.starts[n], self.starts[n + 1]), (k == n) & is_context, np.zeros(len(ids[n]))
            back[np.searchsorted(ids[n], gram[chosen])] = model["backoff"][chosen]
            if n == 0:
                table[rows] = back[0] / 257
            else:
                shorter = ids[n] & U((1 << 8 * (n - 1)) - 1)
                table[rows] = back[:, None] * table[self.starts[n - 1] + np.searchsorted(ids[n - 1], shorter)]
            seen = (k == n + 1) & ~is_context
            at = self.starts[n] + np.searchsorted(ids[n], gram[seen] >> U(8))
            table[at, self.symbol[(gram[seen] & U(255)).astype(np.int64)]] = model["p"][seen]
        self.log = np.log(table).ravel()

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Sum of natural log probabilities of each row's bytes."""
        n, rows = self.order - 1, len(offsets) - 1
        padded = np.full(len(data) + rows * n, self.symbol[10], np.int32)
        at = np.arange(len(data)) + np.repeat(np.arange(1, rows + 1) * n, np.diff(offsets))
        padded[at] = self.symbol[data]
        # state: number of the context of each length that ends at a byte; row: that of the longest known one.
        row, state = np.zeros(len(padded), np.int32), np.ones(len(padded), np.int32)
        for length, step in enumerate(self.next, 1):
            before = np.ones(len(padded), np.int32) if length == 1 else np.concatenate([np.zeros(1, np.int32), state[:-1]])
            state = step.take(before * np.int32(self.size) + padded)
            row = np.where(state > 0, state + np.int32(self.starts[length] - 1), row)
        logs = np.concatenate([[0.0], np.cumsum(self.log.take(row[at - 1].astype(np.int64) * self.size + padded[at]), dtype=np.float64)])
        return logs[offsets[1:]] - logs[offsets[:-1]]


_LAST: dict[str, _Scorer] = {}


def _score_batches(batches: Iterable[pa.RecordBatch], model, name: str, order: int, keep: list[str]) -> Iterator[pa.RecordBatch]:
    if name not in _LAST:
        _LAST.clear()
        _LAST[name] = _Scorer(model.value, order)
    for batch in batches:
        data, offsets = _text.utf8(batch.column("__text"))
        sums, row = np.zeros(len(offsets) - 1), 0
        while row < len(offsets) - 1:
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + (1 << 19), "right")) - 1)
            sums[row:end] = _LAST[name].score(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
            row = end
        arrays = [*(batch.column(c) for c in keep), pa.array(np.diff(offsets)), pa.array(sums)]
        yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "n_bytes", "log_p"])


def training_sample(documents: DataFrame, trusted: DataFrame, how: Model) -> DataFrame:
    """Ids of the trusted documents to train on: all that are not held out, or of each language the first in a hash order, within the bounds.

    With bounds, ids are dealt by hash to as many buckets as make some four documents each; a
    language's first buckets are taken while their rows and bytes fit.
    """
    known = documents.select("doc", "lang", "size").join(trusted, "doc", "left_semi").filter("doc IS NOT NULL AND size > 0")
    known = known.filter(F.pmod(F.xxhash64("doc", F.lit("held out")), F.lit(how.held_one_in)) > 0)
    if how.train_rows is None and how.train_bytes is None:
        return known.select("doc").distinct()
    most_rows, most_bytes = (b if b is not None else 1 << 62 for b in (how.train_rows, how.train_bytes))
    sizes = known.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / 4).cast("long").alias("buckets"))
    dealt = salted_join(known, sizes, ["lang"], "doc").withColumn("bucket", F.pmod(F.xxhash64("doc"), F.col("buckets")))
    dealt = cut(dealt.filter(F.col("bucket") <= most_rows).select("doc", "lang", "size", "bucket"))
    counted = dealt.groupBy("lang", "bucket").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))
    share = most_bytes // max(1, counted.select("lang").distinct().count())
    # With train_rows, at most so many buckets of a language are left; one that is too large by itself is passed over.
    order = Window.partitionBy("lang").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    fitting = counted.filter((F.col("bytes") <= share) & (F.col("rows") <= most_rows))
    taken = fitting.withColumns({"all_rows": F.sum("rows").over(order), "all_bytes": F.sum("bytes").over(order)}).filter((F.col("all_rows") <= most_rows) & (F.col("all_bytes") <= share))
    return dealt.join(taken.select("lang", "bucket"), ["lang", "bucket"], "left_semi").select("doc").distinct()


def _scored_by_joins(rows: DataFrame, model: DataFrame, order: int) -> DataFrame:
    """(doc, lang, n_bytes, log_p) of (doc, lang, __text), by the model's shards: every n-gram that is asked for is weighed once."""
    named = rows.withColumn("text_id", F.sha2("__text", 256))
    asked = cut(named.select("text_id", F.col("__text").alias("text")).mapInArrow(lambda it: _asked_batches(it, order), "text_id string, gram long, n long").groupBy("text_id", "gram").agg(F.max("n").alias("n")))
    weighed = asked.select("gram").distinct().withColumn("p", F.lit(1 / 257).cast("double"))
    for k in range(1, order + 1):
        # A context that is not known leaves everything to the shorter one.
        bits, context = (1 << 8 * k) - 1, F.lit(0).cast("long") if k == 1 else F.shiftright(F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1)), 8)
        own = model.filter((F.col("k") == k) & ~F.col("is_context")).select(F.col("gram").alias("end"), F.col("p").alias("own"))
        back = model.filter((F.col("k") == k - 1) & F.col("is_context")).select(F.col("gram").alias("context"), "backoff")
        met = weighed.withColumns({"end": F.col("gram").bitwiseAND(F.lit(bits)), "context": context}).join(own, "end", "left").join(back, "context", "left")
        weighed = met.select("gram", F.coalesce("own", F.coalesce("backoff", F.lit(1.0)) * F.col("p")).alias("p"))
    sums = asked.join(cut(weighed), "gram").groupBy("text_id").agg(F.sum(F.col("n") * F.log("p")).alias("log_p"))
    sized = named.select("doc", "lang", "text_id", F.octet_length("__text").cast("long").alias("n_bytes"))
    return sized.join(sums, "text_id", "left").select("doc", "lang", "n_bytes", F.coalesce("log_p", F.lit(0.0)).alias("log_p"))


def _scored(rows: DataFrame, model_rows: DataFrame, how: Model) -> DataFrame:
    """(doc, lang, n_bytes, log_p) of (doc, lang, __text) under a model."""
    spark = rows.sparkSession
    size = model_rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if("is_context").alias("contexts"), F.count_if((F.col("k") == 1) & ~F.col("is_context")).alias("letters")).first()
    if size["rows"] > how.most_rows or size["contexts"] * (size["letters"] + 2) > how.most_cells:
        return cut(_scored_by_joins(rows, model_rows, how.order))
    # A row has a probability or a weight, so one column holds both.
    table = model_rows.select("gram", F.coalesce("p", "backoff").alias("value"), F.col("k").cast("byte").alias("k"), "is_context").toArrow()
    arrays = {c: table.column(c).to_numpy() for c in ("gram", "k", "is_context")}
    arrays["p"] = arrays["backoff"] = table.column("value").to_numpy()
    del table
    pa.default_memory_pool().release_unused()
    model, order, name = spark.sparkContext.broadcast(arrays), how.order, f"{id(arrays)}-{size['rows']}-{arrays['p'][:1000].sum()}"
    scored = cut(rows.mapInArrow(lambda it: _score_batches(it, model, name, order, ["doc", "lang"]), "doc long, lang string, n_bytes long, log_p double"))
    # The model has done its work; the driver and the executors need not hold it any longer.
    model.destroy()
    return scored


def score_documents(df: DataFrame, trusted: DataFrame, text: str = "text", doc: str = "doc_id", lang: str = "lang", *, how: Model = Model()) -> DataFrame:  # noqa: B008
    """(doc_id, lang, n_bytes, perplexity, threshold, kept) for every row of ``df``.

    ``trusted`` has the ids (``doc``) of trusted documents.  Perplexity is per
    byte, with the mean of the text's language mixed in for ``prior_bytes``
    bytes.  A null or empty text has no
    perplexity and is kept: nothing speaks against it.  A null language is a
    language of its own; repeated rows are scored each; without any trusted
    text nothing is rejected.
    """
    rows = df.select(F.col(f"`{doc}`").cast("long").alias("doc"), F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("\0")).alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    trusted = trusted.select(F.col(trusted.columns[0]).cast("long").alias("doc")).distinct()
    chosen = cut(training_sample(rows.withColumn("size", F.octet_length("__text")), trusted, how))
    training = rows.filter("__text <> ''").join(chosen, "doc", "left_semi").select(F.col("__text").alias("text"))
    counts = cut(training.mapInArrow(lambda it: _count_batches(it, how.order), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    if not counts.take(1):
        return rows.select(F.col("doc").alias("doc_id"), F.nullif("lang", F.lit("\0")).alias("lang"), F.octet_length("__text").cast("long").alias("n_bytes"), F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"), F.lit(True).alias("kept"))
    scored = _scored(rows, kneser_ney(counts, how.order), how)
    # Means are sums of rounded values, so that they come out alike in every run.
    held = cut(scored.filter("n_bytes > 0").join(trusted, "doc", "left_semi").join(chosen, "doc", "left_anti").select("lang", "n_bytes", "log_p"))
    means = cut(held.groupBy("lang").agg((F.sum(F.round(F.col("log_p") * 1000).cast("long")) / F.sum("n_bytes") / 1000).alias("mean"), F.count(F.lit(1)).alias("rows"), F.sum("n_bytes").alias("bytes")))
    overall = means.agg(F.sum(F.col("mean") * F.col("bytes")) / F.sum("bytes")).first()[0]

    def judged(df: DataFrame) -> DataFrame:
        mean = F.coalesce("mean", F.lit(overall if overall is not None else 0.0))
        drawn = (F.col("log_p") + how.prior_bytes * mean) / (F.col("n_bytes") + how.prior_bytes)
        return df.join(means.select("lang", "mean"), "lang", "left").withColumn("perplexity", F.when(F.col("n_bytes") > 0, F.round(F.exp(-drawn), 4)))

    own = judged(held)
    quantile = F.percentile("perplexity", F.lit(how.quantile)) * how.margin
    of_all = F.lit(own.agg(quantile).first()[0]).cast("double")
    weight = F.col("rows") / (F.col("rows") + how.prior_rows)
    of_lang = cut(own.groupBy("lang").agg(quantile.alias("limit"), F.count(F.lit(1)).alias("rows")).select("lang", F.round(weight * F.col("limit") + (1 - weight) * of_all, 6).alias("limit")))
    final = judged(scored).join(of_lang, "lang", "left").withColumn("threshold", F.coalesce("limit", of_all))
    kept = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return final.select(F.col("doc").alias("doc_id"), F.nullif("lang", F.lit("\0")).alias("lang"), "n_bytes", "perplexity", "threshold", kept.alias("kept"))
