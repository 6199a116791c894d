"""A quality classifier: perplexity under a modified Kneser-Ney model of trusted text.

The model counts runs of up to five bytes per language and is interpolated over all
lengths with three discounts each. Counts, continuation counts, discounts and
probabilities are worked out by joins on (language, run), sharded by hash. Up to ``Fit.carried``
rows the model goes to the documents in the scan. A larger one stays in its tables: documents
are stored in blocks, a block asks for each of its runs once, and the costs return by one
shuffle on the block (``scores_by_joins``), so no model is ever held whole. Both give the same.

Trusted documents are those labelled of quality 1 and not toxic. With ``Fit.folds`` the models
come from all of them, of any length, and the thresholds from all of them too: each trusted text is
of one fold and is scored for the thresholds by a model of the other folds, as a text that a
model has counted fits it too well. Copies of a text are of one fold. Without folds four fifths of a
language's trusted documents make the model and the others the thresholds; ``sample``,
``total`` and ``max_chars`` are for callers who want a smaller model.
Thresholds are taken per language and length class, shrunk where there are few documents
(``thresholds``), and every text is scored whole. Two scores have a threshold each: the
perplexity of the text, and that of its worst stretch of ``Fit.stretch`` words, so that a short
foreign or toxic passage shows in a long text.

Cases: a document whose language has no trusted document at all has no model, no perplexity
and no threshold, and is kept. One without a language is judged as of the language whose
model fits best. A null or empty text has no perplexity and is not kept. Repeated rows are
each answered; labels that disagree make a document untrusted. Only ``doc_id``, ``text``
and ``lang``, and of the labels ``doc_id``, ``quality`` and ``toxic`` are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbflow.llm.common import in_sieve, map_rows, ship, sieve, text_key, written
from curbflow.llm.matching import BLOCK_BYTES, grams_of

RUN = 5
_BITS = 9
_SYMBOLS = 257


@dataclass(frozen=True)
class Fit:
    folds: int = 0  # models from all trusted documents, thresholds from all by folds; 0: from a part each
    sample: int | None = None  # documents of a language, without folds
    most: float = 0.8  # of its trusted documents, without folds; the others give the thresholds
    total: int | None = None  # documents of all languages, without folds
    max_chars: int = (1 << 31) - 1  # longer trusted documents are not counted, without folds
    carried: int = 6_000_000  # rows of model tables that go to the scan; larger models answer by joins
    quantile: float = 0.998  # of the trusted perplexities, and of those of the worst stretches
    stretch: int = 4  # words
    classes: tuple[int, ...] = (100, 400, 1600)  # bytes at which a new length class starts
    enough: int = 500  # trusted documents from which a length class's own quantile counts alone
    steady: int = 20  # trusted documents at which a length class's mean counts as much as its language's
    grid: float = 0.0005  # of log10 perplexity, on which quantiles are counted


@dataclass(frozen=True)
class Model:
    """Per order: sorted runs with log10 probabilities; contexts with log10 of what they
    leave to the shorter run."""

    runs: list[np.ndarray]
    costs: list[np.ndarray]
    contexts: list[np.ndarray]
    rests: list[np.ndarray]


def trusted_ids(labels: DataFrame) -> DataFrame:
    by_id = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    return by_id.where("q = 1 and t = 0").select("doc_id")


def _low(c: Column, symbols: int) -> Column:
    return c.bitwiseAND(F.lit((1 << (_BITS * symbols)) - 1).cast("long"))


def _run_counts(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            parts: dict[str, list] = {}
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                parts.setdefault(lang, []).append(grams_of(text, RUN - 1))
            for lang, own in parts.items():
                runs, n = np.unique(np.concatenate(own), return_counts=True)
                yield {"lang": [lang] * len(runs), "g": runs, "c": n}

    rows = map_rows(texts, run, "lang string, g bigint, c bigint", batch=500)
    return rows.groupBy("lang", "g").agg(F.sum("c").alias("c"))


def _chosen(docs: DataFrame, labels: DataFrame, how: Fit) -> DataFrame:
    """``doc_id, lang`` of the trusted documents that make the models, without folds."""
    ids = trusted_ids(labels)
    small = F.char_length("text") <= how.max_chars
    pool = docs.where("text is not null and text <> '' and lang is not null").where(small).select("doc_id", "lang")
    pool = written(pool.join(ids, "doc_id", "left_semi").distinct(), "pool")
    # an even share of the hashes, so that no language is ranked in one place; one document at least
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))
    each = pool.groupBy("lang").agg(F.count("*").alias("n"), F.min(place).alias("first"), F.max(place).alias("last"))
    each = written(each, "languages")
    share = F.lit(how.most)
    bounds = [] if how.sample is None else [how.sample]
    bounds += [] if how.total is None else [max(1, how.total // max(each.count(), 1))]
    if bounds:
        share = F.least(F.lit(min(bounds)) / F.col("n"), share)
    share = each.select("lang", "n", "first", "last", share.alias("share"))
    # of two or more at least one stays outside
    mine = ((place < F.col("share")) & ((place < F.col("last")) | (F.col("n") == 1))) | (place == F.col("first"))
    return written(pool.join(F.broadcast(share), "lang").where(mine).select("doc_id", "lang"), "sample")


def fit(docs: DataFrame, labels: DataFrame, how: Fit = Fit()) -> tuple[dict[str, Model], DataFrame]:
    """Models by language, and the ``doc_id, lang`` they were made from, without folds."""
    chosen = _chosen(docs, labels, how)
    return collected(model_tables(_run_counts(_texts_of(docs, chosen, how)))), chosen


def _texts_of(docs: DataFrame, chosen: DataFrame, how: Fit) -> DataFrame:
    # not broadcast unless Spark measures it as small
    texts = docs.where("text is not null and text <> '' and lang is not null").where(F.char_length("text") <= how.max_chars)
    return texts.join(chosen, ["doc_id", "lang"], "left_semi").select("text", "lang")


def in_folds(docs: DataFrame, labels: DataFrame, folds: int) -> DataFrame:
    """``doc_id, k1, k2, text, lang, fold`` of all trusted documents, stored.

    The fold is that of the text, -1 for a text of no language or the only one of its language.
    Of two or more texts of a language at least one is of another fold.
    """
    rows = docs.where("text is not null and text <> ''").select("doc_id", *text_key(), "text", "lang")
    rows = written(rows.join(trusted_ids(labels), "doc_id", "left_semi"), "trusted")
    fold = F.pmod(F.col("k1"), F.lit(folds)).cast("int")
    each = rows.where("lang is not null").groupBy("lang").agg(
        F.min(fold).alias("low"), F.max(fold).alias("high"), F.min("k1").alias("first"), F.max("k1").alias("last")
    )
    moved = F.when(F.col("k1") == F.col("last"), (fold + 1) % folds).otherwise(fold)
    fold = F.when(F.col("low") < F.col("high"), fold).when(F.col("first") < F.col("last"), moved).otherwise(-1)
    rows = rows.join(F.broadcast(each), "lang", "left")  # a row per language
    return rows.select("doc_id", "k1", "k2", "text", "lang", fold.alias("fold"))


def _fold_name(lang: Column, fold: Column) -> Column:
    return F.concat_ws("\0", lang, fold.cast("string"))


def _fold_counts(rows: DataFrame, folds: int) -> DataFrame:
    """Counts of the models of all texts (fold -1) and of those without each fold."""
    texts = rows.where("lang is not null").select("text", _fold_name(F.col("lang"), F.col("fold")).alias("lang"))
    tail = F.substring_index("lang", "\0", -1)
    lang = F.col("lang").substr(F.lit(1), F.length("lang") - F.length(tail) - 1)
    parts = _run_counts(texts).withColumns({"of": tail.cast("int"), "lang": lang})
    others = F.filter(F.sequence(F.lit(-1), F.lit(folds - 1)), lambda f: (f != F.col("of")) | (f == -1))
    spread = parts.select("lang", F.explode(others).alias("fold"), "g", "c")
    return spread.groupBy(_fold_name(F.col("lang"), F.col("fold")).alias("lang"), "g").agg(F.sum("c").alias("c"))


def model_tables(counts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """Per length of run, shortest first: ``lang, g, p`` of the runs, and ``lang, x, rest`` of
    the contexts, what they leave to the shorter run."""
    levels = [written(counts, "runs")]
    for m in range(RUN - 1, 0, -1):
        # how many different bytes precede a run, not how often it occurs
        shorter = levels[-1].groupBy("lang", _low(F.col("g"), m).alias("g")).agg(F.count("*").alias("c"))
        levels.append(written(shorter, "runs"))
    levels.reverse()  # shortest first
    lower = None
    tables = []
    for level in levels:
        n = [F.sum((F.col("c") == i).cast("double")).alias(f"n{i}") for i in (1, 2, 3, 4)]
        found = level.groupBy("lang").agg(*n)
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))

        def discount(k: int, y: Column = y) -> Column:
            here, above = F.col(f"n{k}"), F.col(f"n{k + 1}")
            exact = F.when((F.col("n1") > 0) & (here > 0), k - (k + 1) * y * above / here)
            return F.least(F.greatest(F.coalesce(exact, F.lit(0.5 * k)), F.lit(0.05)), F.lit(k - 0.05)).alias(f"d{k}")

        found = found.select("lang", *(discount(k) for k in (1, 2, 3)))
        taken = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = level.join(found, "lang").select("lang", "g", F.shiftright("g", _BITS).alias("x"), "c", taken.alias("d"))
        stats = rows.groupBy("lang", "x").agg(F.sum("c").alias("s"), (F.sum("d") / F.sum("c")).alias("rest"))
        rows = rows.join(stats, ["lang", "x"])
        own = (F.col("c") - F.col("d")) / F.col("s")
        if lower is None:
            rows = rows.select("lang", "g", (own + F.col("rest") / _SYMBOLS).alias("p"))
        else:
            m = len(tables)
            rows = rows.withColumn("short", _low(F.col("g"), m)).join(
                lower.select("lang", F.col("g").alias("short"), F.col("p").alias("below")), ["lang", "short"]
            )
            rows = rows.select("lang", "g", (own + F.col("rest") * F.col("below")).alias("p"))
        lower = written(rows, "probabilities")
        tables.append((lower, written(stats.select("lang", "x", "rest"), "rests")))
    return tables


def collected(tables: list[tuple[DataFrame, DataFrame]]) -> dict[str, Model]:
    """The models as arrays; only for tables that are known to be small, see ``Fit.carried``."""
    models: dict[str, Model] = {}
    for p, rest in tables:
        runs, rests = p.toArrow().to_pandas(), rest.toArrow().to_pandas()
        left_of = dict(list(rests.groupby("lang")))
        for lang, own in runs.groupby("lang"):
            model = models.setdefault(lang, Model([], [], [], []))
            own = own.sort_values("g")
            model.runs.append(own["g"].to_numpy())
            model.costs.append(np.log10(own["p"].to_numpy()))
            left = left_of[lang].sort_values("x")
            model.contexts.append(left["x"].to_numpy())
            model.rests.append(np.log10(left["rest"].to_numpy()))
    return models


def symbol_costs(model: Model, text: str) -> np.ndarray:
    """-log10 of the probability of every byte, and of the text's end."""
    grams = grams_of(text, RUN - 1)
    out, left = np.zeros(len(grams)), np.arange(len(grams))
    for m in range(RUN, 0, -1):
        own = grams & ((1 << (_BITS * m)) - 1)
        at = np.searchsorted(model.runs[m - 1], own)
        at[at == len(model.runs[m - 1])] = 0
        seen = model.runs[m - 1][at] == own
        out[left[seen]] -= model.costs[m - 1][at[seen]]
        grams, left = grams[~seen], left[~seen]
        if not len(grams):
            return out
        x = own[~seen] >> _BITS
        at = np.searchsorted(model.contexts[m - 1], x)
        at[at == len(model.contexts[m - 1])] = 0
        known = model.contexts[m - 1][at] == x
        out[left[known]] -= model.rests[m - 1][at[known]]
    out[left] += np.log10(_SYMBOLS)
    return out


_SPACES = np.isin(np.arange(256), list(b" \t\n\v\f\r"))


def worst_stretch(costs: np.ndarray, text: str, words: int) -> float:
    """The highest mean cost of so many words in a row, of all if there are fewer."""
    space = _SPACES[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    edges = np.concatenate([starts, [len(space)]])
    if len(edges) <= words + 1:
        return float(costs.mean())
    sums = np.concatenate([[0.0], np.cumsum(costs)])[edges]
    return float(((sums[words:] - sums[:-words]) / (edges[words:] - edges[:-words])).max())


_SCORES = "doc_id bigint, k1 bigint, k2 bigint, lang string, model string, bytes bigint, cost double, worst double"


def _scored(texts: list, langs: list, names: dict[str, str], cost_of: Callable[[str, str], np.ndarray], how: Fit) -> tuple:
    """``model, bytes, cost, worst`` as columns. ``names`` holds the model of each language."""
    out = []
    for text, lang in zip(texts, langs):
        # without a language the model that fits best; a language without a model is not judged
        own = _asked(lang, names)
        if not text or not own:
            out.append((None, len((text or "").encode("utf-8", "surrogatepass")), None, None))
            continue
        found = []
        for name in own:
            costs = cost_of(names[name], text)
            found.append((float(costs.mean()), name, costs))
        cost, name, costs = min(found, key=lambda f: f[:2])
        out.append((name, len(costs) - 1, cost, worst_stretch(costs, text, how.stretch)))
    return tuple(map(list, zip(*out))) if out else ([], [], [], [])


def _asked(lang: str | None, names: dict[str, str]) -> list[str]:
    return [lang] if lang in names else sorted(names) if lang is None else []


def scores(rows: DataFrame, models: Broadcast, names: dict[str, str], how: Fit = Fit()) -> DataFrame:
    """``doc_id, k1, k2, lang, model, bytes, cost, worst`` of rows of ``doc_id, k1, k2, text, lang``:
    log10 perplexity of the text and of its worst stretch, null for no text or model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        cost_of = lambda name, text: symbol_costs(models.value[name], text)
        for b in batches:
            name, n, cost, worst = _scored(b.column(3).to_pylist(), b.column(4).to_pylist(), names, cost_of, how)
            yield {"doc_id": b.column(0), "k1": b.column(1), "k2": b.column(2), "lang": b.column(4), "model": name, "bytes": n, "cost": cost, "worst": worst}

    return map_rows(rows.select("doc_id", "k1", "k2", "text", "lang"), run, _SCORES, batch=500)


def _stored_blocks(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyspark import TaskContext

        block, size = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            blocks = []
            for t in b.column(3).to_pylist():
                if size > BLOCK_BYTES:
                    block, size = block + 1, 0
                size += len(t or "") + 100
                blocks.append(block)
            yield {**{n: b.column(i) for i, n in enumerate(("doc_id", "k1", "k2", "text", "lang"))}, "block": blocks}

    schema = "doc_id bigint, k1 bigint, k2 bigint, text string, lang string, block bigint"
    return written(map_rows(rows.select("doc_id", "k1", "k2", "text", "lang"), run, schema, batch=500), "blocks")


def _block_runs(blocks: DataFrame, names: dict[str, str]) -> DataFrame:
    """``block, lang, g``: the runs that a block's texts need of a model, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now, parts = None, {}

        def asked() -> Iterator[dict]:
            for name, own in parts.items():
                runs = np.unique(np.concatenate(own))
                yield {"block": np.full(len(runs), now), "lang": [name] * len(runs), "g": runs}

        for b in batches:
            for text, lang, block in zip(*(b.column(i).to_pylist() for i in range(3))):
                if block != now:
                    yield from asked()
                    now, parts = block, {}
                grams = np.unique(grams_of(text, RUN - 1)) if text else None
                for name in _asked(lang, names) if text else []:
                    own = parts.setdefault(names[name], [])
                    own.append(grams)
                    if len(own) > 500:
                        own[:] = [np.unique(np.concatenate(own))]
        yield from asked()

    return map_rows(blocks.select("text", "lang", "block"), run, "block bigint, lang string, g bigint", batch=500)


def _run_costs(asked: DataFrame, tables: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """``lang, g, cost``: what ``symbol_costs`` works out, for a table of runs."""
    rows = asked.select("lang", "g", F.lit(0.0).alias("cost"), F.lit(False).alias("done"))
    for m in range(RUN, 0, -1):
        p, rest = tables[m - 1]
        rows = rows.withColumns({"own": _low(F.col("g"), m), "x": F.shiftright(_low(F.col("g"), m), _BITS)})
        rows = rows.join(p.select("lang", F.col("g").alias("own"), "p"), ["lang", "own"], "left")
        rows = rows.join(rest.select("lang", "x", "rest"), ["lang", "x"], "left")
        step = F.coalesce(F.log10("p"), F.log10("rest"), F.lit(0.0))
        rows = rows.select(
            "lang", "g", F.when(F.col("done"), F.col("cost")).otherwise(F.col("cost") - step).alias("cost"),
            (F.col("done") | F.col("p").isNotNull()).alias("done"),
        )
    return rows.select("lang", "g", F.when(F.col("done"), F.col("cost")).otherwise(F.col("cost") + float(np.log10(_SYMBOLS))).alias("cost"))


def scores_by_joins(rows: DataFrame, tables: list[tuple[DataFrame, DataFrame]], names: dict[str, str], how: Fit = Fit()) -> DataFrame:
    """``scores`` where the models are tables of any size."""
    blocks = _stored_blocks(rows)
    asked = written(_block_runs(blocks, names), "asked")
    costs = written(_run_costs(asked.select("lang", "g").distinct(), tables), "costs")
    answers = asked.join(costs, ["lang", "g"])
    columns = [f.split()[0] for f in _SCORES.split(", ")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        runs, found = right["g"].to_numpy(), right["cost"].to_numpy()
        kind = pa.compute.dictionary_encode(right["lang"]).combine_chunks()
        kind = kind.chunk(0) if isinstance(kind, pa.ChunkedArray) else kind
        own = {}
        for i, name in enumerate(kind.dictionary.to_pylist()):
            at = np.flatnonzero(kind.indices.to_numpy() == i)
            at = at[np.argsort(runs[at])]
            own[name] = runs[at], found[at]

        def cost_of(name: str, text: str) -> np.ndarray:
            return own[name][1][np.searchsorted(own[name][0], grams_of(text, RUN - 1))]

        name, n, cost, worst = _scored(left["text"].to_pylist(), left["lang"].to_pylist(), names, cost_of, how)
        values = [left["doc_id"], left["k1"], left["k2"], left["lang"], pa.array(name, pa.string()), pa.array(n, pa.int64())]
        return pa.table(dict(zip(columns, [*values, pa.array(cost, pa.float64()), pa.array(worst, pa.float64())])))

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, _SCORES)


def _scored_by(rows: DataFrame, tables: list[tuple[DataFrame, DataFrame]], names: dict[str, str], how: Fit) -> DataFrame:
    """Scores by the named models, stored."""
    own = [tuple(t.where(F.col("lang").isin(list(names.values()))) for t in pair) for pair in tables] if names else []
    if sum(t.count() for pair in own for t in pair) > how.carried:
        return written(scores_by_joins(rows, own, names, how), "scores")
    models = rows.sparkSession.sparkContext.broadcast(collected(own))
    scored = written(scores(rows, models, names, how), "scores")
    models.destroy()
    return scored


def _class(how: Fit) -> Column:
    return sum(((F.col("bytes") >= at).cast("int") for at in how.classes), F.lit(0))


def _quantile(q: float) -> Column:
    """The bin of ``bins`` (sorted, with counts) that holds the quantile of ``n``."""
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("bin"))
    step = lambda acc, b: F.struct(
        (acc["seen"] + b["count"]).alias("seen"),
        F.when(acc["bin"].isNotNull(), acc["bin"]).when(acc["seen"] + b["count"] >= F.col("n") * q, b["bin"]).alias("bin"),
    )
    return F.aggregate("bins", start, step)["bin"]


def thresholds(scored: DataFrame, labels: DataFrame, chosen: DataFrame, how: Fit = Fit()) -> DataFrame:
    """``model, class, threshold, worst_threshold`` of every model and length class.

    From the trusted documents that are not ``chosen``, those that the model was made from; from
    all of them where that leaves a language none. They are counted on a grid, so a language is never gathered.
    A class's mean is shrunk to its language's, and its quantile to that of all languages'
    distances from their means in the class. So a small language is judged, but not by an
    order statistic that it cannot give.
    """
    trusted = scored.where("cost is not null").join(trusted_ids(labels), "doc_id", "left_semi")
    known = chosen.select("doc_id", F.col("lang").alias("model"), F.lit(False).alias("out"))
    trusted = trusted.join(known, ["doc_id", "model"], "left").select(
        "model", _class(how).alias("class"), "cost", "worst", F.coalesce("out", F.lit(True)).alias("out")
    )
    both = trusted.select("model", "class", "out", F.explode(F.array(*(
        F.struct(F.lit(c).alias("score"), F.floor(F.col(c) / how.grid).alias("bin")) for c in ("cost", "worst")
    ))).alias("of")).select("model", "class", "out", "of.*")
    counted = written(both.groupBy("model", "class", "score", "bin", "out").count(), "bins")
    held = counted.groupBy("model").agg(F.bool_or("out").alias("some"))  # a row per language of the bounded models
    bins = counted.join(F.broadcast(held), "model").where("out or not some")
    bins = bins.groupBy("model", "class", "score", "bin").agg(F.sum("count").alias("count"))
    mean = F.sum(F.col("bin") * F.col("count")) / F.sum("count")
    languages = bins.groupBy("model", "score").agg(mean.alias("of_language"))
    # a few thousand bins a language and class, whatever the number of documents
    own = bins.groupBy("model", "class", "score").agg(
        F.sum("count").alias("n"), mean.alias("mean"),
        F.sort_array(F.collect_list(F.struct("bin", "count"))).alias("bins"),
    )
    every = languages.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(how.classes)))).alias("class"))
    rows = every.join(own, ["model", "class", "score"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    middle = (F.col("n") * F.coalesce("mean", F.lit(0.0)) + how.steady * F.col("of_language")) / (F.col("n") + how.steady)
    rows = written(rows.withColumns({"middle": middle, "at": _quantile(how.quantile)}).drop("bins"), "classes")
    away = bins.join(rows.select("model", "class", "score", "middle"), ["model", "class", "score"])
    away = away.groupBy("score", "class", F.floor(F.col("bin") - F.col("middle")).alias("bin")).agg(F.sum("count").alias("count"))

    def quantile_of(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        held = df.groupBy(*keys).agg(F.sum("count").alias("n"), F.sort_array(F.collect_list(F.struct("bin", "count"))).alias("bins"))
        return F.broadcast(held.select(*keys, _quantile(how.quantile).alias(name)))

    rows = rows.join(quantile_of(away, ["score", "class"], "of_class"), ["score", "class"], "left")
    whole = away.groupBy("score", "bin").agg(F.sum("count").alias("count"))
    rows = rows.join(quantile_of(whole, ["score"], "of_all"), "score")
    weight = F.least(F.col("n") / F.lit(float(max(how.enough, 1))), F.lit(1.0))
    spare = F.col("middle") + F.coalesce("of_class", "of_all")
    limit = (weight * F.coalesce("at", F.lit(0)) + (1 - weight) * spare + 1) * how.grid
    of = lambda score: F.max(F.when(F.col("score") == score, limit))
    return rows.groupBy("model", "class").agg(of("cost").alias("threshold"), of("worst").alias("worst_threshold"))


def judged(docs: DataFrame, labels: DataFrame, how: Fit = Fit()) -> DataFrame:
    """``doc_id, k1, k2, lang, model, bytes, perplexity, threshold, worst,
    worst_threshold, kept`` of every row."""
    rows = docs.select("doc_id", *text_key(), "text", "lang")
    if how.folds:
        known = in_folds(docs, labels, how.folds)
        tables = model_tables(_fold_counts(known, how.folds))
        # a row per language
        langs = [r["lang"] for r in known.where("lang is not null").select("lang").distinct().collect()]
        name_of = lambda f: {lang: f"{lang}\0{f}" for lang in langs}
        scored = _scored_by(rows, tables, name_of(-1), how)
        parts = [_scored_by(known.where(F.col("fold") == f), tables, name_of(f), how) for f in range(-1, how.folds)]
        held, chosen = reduce(DataFrame.unionAll, parts), known.select("doc_id", "lang").limit(0)
    else:
        chosen = _chosen(docs, labels, how)
        tables = model_tables(_run_counts(_texts_of(docs, chosen, how)))
        langs = [r["lang"] for r in chosen.select("lang").distinct().collect()]
        held = scored = _scored_by(rows, tables, {lang: lang for lang in langs}, how)
    limits = written(thresholds(held, labels, chosen, how), "thresholds")
    # one row per language of the bounded models and length class
    rows = scored.withColumn("class", _class(how)).join(F.broadcast(limits), ["model", "class"], "left")
    within = lambda score, limit: F.coalesce(F.col(score) <= F.col(limit), F.lit(True))
    kept = (F.col("bytes") > 0) & within("cost", "threshold") & within("worst", "worst_threshold")
    return rows.select(
        "doc_id", "k1", "k2", "lang", "model", "bytes",
        F.pow(F.lit(10.0), "cost").alias("perplexity"),
        F.pow(F.lit(10.0), "threshold").alias("threshold"),
        F.pow(F.lit(10.0), "worst").alias("worst"),
        F.pow(F.lit(10.0), "worst_threshold").alias("worst_threshold"),
        kept.alias("kept"),
    )


def keep_trusted_like(docs: DataFrame, labels: DataFrame, how: Fit = Fit()) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, unchanged. Only rows that may be
    rejected are shuffled: a bitmap of their keys tells the scan."""
    # the verdict depends on the text and the language alone
    lang = F.coalesce("lang", F.lit("\0")).alias("l")
    gone = written(judged(docs, labels, how).where("not kept").select("k1", "k2", lang).distinct(), "rejected")
    bitmap = sieve(gone.select("k1").distinct(), "k1")
    packed = docs.select(F.struct(*(F.col(f"`{n}`") for n in docs.columns)).alias("row"), *text_key(), lang)
    ship(docs.sparkSession)

    def passing(inside: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(in_sieve(bitmap.value, b.column(1).to_numpy()) == inside))

        return packed.mapInArrow(run, packed.schema)

    left = passing(True).join(gone, ["k1", "k2", "l"], "left_anti")
    return passing(False).select("row.*").unionAll(left.select("row.*"))
