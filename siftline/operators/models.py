"""Models behind interfaces: providers that rewrite text, scorers, embedders, and the arithmetic around them.

No provider here calls a network. ``Echo`` is a deterministic stand-in; anything with the
same ``complete`` method can take its place and is built once for each partition.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let


class Provider(Protocol):
    def complete(self, instruction: str, text: str) -> tuple[str, float | None]:
        """The answer and the log probability of its tokens, if there is one."""


@dataclass
class Echo:
    """Answers by rule: ``upper``, ``reverse``, ``first`` word, or the text itself."""

    name: str = "echo"

    def complete(self, instruction: str, text: str) -> tuple[str, float | None]:
        if not text:
            raise ValueError("empty text")
        rules: dict[str, Callable[[str], str]] = {"upper": str.upper, "reverse": lambda t: t[::-1], "first": lambda t: t.split()[0]}
        return rules.get(instruction, str)(text), -len(text) / 1000


@dataclass
class ModelSettings:
    """What a run of a model is told."""

    instructions: Sequence[str] = ("",)
    provider: Callable[[], Provider] = Echo
    system_prompt: str = ""
    max_tokens: int = 1024
    most_at_once: int = 8
    pause_seconds: float = 0.0
    retries: int = 2
    metadata: dict = field(default_factory=dict)


ANSWER = "text_out string, steps array<string>, logprob double, proba double, model string, instruction string, metadata string, success boolean, error_message string"


def _answer(provider: Provider, s: ModelSettings, text: str | None) -> dict:
    now, steps, logprob, error = text, [], None, None
    for instruction in s.instructions:
        for attempt in range(s.retries + 1):
            try:
                now, lp = provider.complete(instruction, now or "")
                logprob = lp if logprob is None else logprob + (lp or 0.0)
                steps.append(now)
                error = None
                break
            except Exception as e:
                error = str(e)
                if s.pause_seconds:
                    time.sleep(s.pause_seconds * 2**attempt)
        if error is not None:
            break
    fine = error is None
    return {
        "text_out": now if fine else None, "steps": steps, "logprob": logprob, "proba": None if logprob is None else float(np.exp(logprob)), "model": getattr(provider, "name", type(provider).__name__),
        "instruction": "\n".join(s.instructions), "metadata": json.dumps(s.metadata, sort_keys=True), "success": fine, "error_message": error,
    }


def run_model(df: DataFrame, text: str, settings: ModelSettings | None = None) -> DataFrame:
    """``df`` with a model's answers: instructions in turn, calls in parallel within a batch, errors as rows."""
    s = settings or ModelSettings()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = s.provider()
        with ThreadPoolExecutor(s.most_at_once) as pool:
            for pdf in batches:
                rows = list(pool.map(lambda t: _answer(provider, s, t), pdf[text]))
                answers = pd.DataFrame(rows, index=pdf.index, columns=[c.split()[0] for c in ANSWER.split(", ")])
                yield pd.concat([pdf, answers], axis=1)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{kinds}, {ANSWER}")


def run_models(df: DataFrame, text: str, settings: dict[str, ModelSettings]) -> DataFrame:
    """Every row by every model: one run for each, all in one table."""
    from functools import reduce

    runs = [run_model(df, text, s).withColumn("model", F.lit(name)) for name, s in settings.items()]
    return reduce(DataFrame.unionByName, runs)


def run_distinct(df: DataFrame, text: str, settings: ModelSettings | None = None) -> DataFrame:
    """Like ``run_model``, but each distinct text is sent once."""
    once = run_model(df.select(text).distinct(), text, settings)
    return df.join(once, text, "left")


def translate_cached(df: DataFrame, cache: DataFrame, text: str, source: str, target: str, settings: ModelSettings | None = None) -> DataFrame:
    """``df`` with ``translated_text``, from the cache where it has the sentence for these languages, else from the model."""
    known = cache.where((F.col("source_language") == source) & (F.col("target_language") == target)).select(F.col("sentence").alias(text), "translated_text")
    distinct = df.select(text).where(F.col(text).isNotNull()).distinct()
    fresh = run_model(distinct.join(known, text, "left_anti"), text, settings).select(text, F.col("text_out").alias("translated_text"))
    return df.join(known.unionByName(fresh), text, "left")


def prompt(instruction: Column, text: Column) -> Column:
    """The request as a model gets it."""
    return F.format_string("{'instruction': '%s','text_to_transform': '%s'}", instruction, text)


def fill_template(template: str, text: Column) -> Column:
    return F.replace(F.lit(template), F.lit("[INPUT]"), text)


def after_marker(text: Column, marker: str) -> Column:
    return F.when(F.contains(text, F.lit(marker)), F.substring_index(text, marker, -1)).otherwise(text)


def with_glossary(text: str, glossary: dict[str, str], translate: Callable[[str], str]) -> str:
    """Glossary terms are put in verbatim, everything between them is translated, blanks stay."""
    if not glossary:
        return translate(text)
    pattern = re.compile("(" + "|".join(re.escape(t) for t in sorted(glossary)) + ")")
    return "".join(glossary[p] if p in glossary else (translate(p) if p.strip() else p) for p in pattern.split(text))


def translate_with_glossary(text: Column, glossary: dict[str, str], provider: Callable[[], Provider] = Echo, instruction: str = "upper") -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        p = provider()
        for texts in batches:
            yield texts.map(lambda t: None if t is None else with_glossary(t, glossary, lambda x: p.complete(instruction, x)[0]))

    return run(text)


def google_cost(chars: Column) -> Column:
    """Tiered price in dollars."""
    m = chars.cast("double") / 1e6
    steps = [(250, 20.0, 0.0, 0), (2500, 60.0, 20_000.0, 250), (4000, 40.0, 155_000.0, 2500)]
    out = 215_000.0 + (m - 4000) * 30.0
    for top, rate, base, start in reversed(steps):
        out = F.when(m <= top, base + (m - start) * rate).otherwise(out)
    return out


def deepl_cost(chars: Column) -> Column:
    return 5 + chars.cast("double") / 1e6 * 20


def running_cost(text: Column, rate: float = 0.00002) -> Column:
    return F.length(text) * rate


def probability(logprobs: Column) -> Column:
    """exp of the sum of an array of log probabilities."""
    return F.exp(F.aggregate(logprobs, F.lit(0.0), lambda a, x: a + x))


def fit_relevance(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", features: int = 1 << 14):
    """A text classifier: hashed words and logistic regression; a Spark ML model whose ``probability`` scores documents."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, RegexTokenizer

    rows = docs.join(labels.select(id_col, F.col(label).cast("double").alias("label")), id_col)
    stages = [RegexTokenizer(inputCol=text, outputCol="_w", pattern=r"[^\p{L}\p{N}]+"), HashingTF(inputCol="_w", outputCol="_f", numFeatures=features), LogisticRegression(featuresCol="_f", regParam=0.05, maxIter=30)]
    return Pipeline(stages=stages).fit(rows)


def score_relevance(model, docs: DataFrame, out: str = "score") -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(docs)
    return scored.select(*docs.columns, vector_to_array("probability")[1].alias(out))


def embed_words(tokens: DataFrame, vectors: DataFrame, key: str, token: str, vector: str, repair: bool = True) -> DataFrame:
    """(key, vector): the mean of a document's word vectors. Unknown words take the nearest known word within two edits,
    found through equal forms with up to two characters deleted, so no pair of words is compared that cannot match."""
    known = vectors.select(F.col(token), F.col(vector))
    words = tokens.select(token).distinct()
    found = words.join(known, token)
    if repair:
        deleted = lambda w: F.array_distinct(F.concat(F.array(w), _less_one(w), F.flatten(F.transform(_less_one(w), _less_one))))
        missing = words.join(known, token, "left_anti").select(F.col(token).alias("miss"), F.explode(deleted(F.col(token))).alias("form"))
        forms = known.select(F.col(token).alias("hit"), F.explode(deleted(F.col(token))).alias("form"))
        pairs = missing.join(forms, "form").select("miss", "hit").distinct().withColumn("d", F.levenshtein("miss", "hit")).where("d <= 2")
        best = pairs.groupBy("miss").agg(F.min(F.struct("d", "hit")).alias("b")).select(F.col("miss").alias("_m"), F.col("b.hit").alias(token))
        found = found.unionByName(best.join(known, token).select(F.col("_m").alias(token), vector))
    # spread by document before vectors come in: a word's vector is many times its bytes, and few words may have most of the tokens
    spread = tokens.repartition(int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    whole = spread.join(found, token).where(F.size(vector) > 0).select(key, vector)
    return whole.repartition(key).groupBy(key).agg(F.collect_list(vector).alias(vector)).select(key, _mean(F.col(vector)).alias(vector))


def _mean(vectors: Column) -> Column:
    """The mean of each dimension, without nulls, to six places."""

    def one(d: Column) -> Column:
        return let(F.filter(F.transform(vectors, lambda v: F.get(v, d).cast("double")), lambda x: x.isNotNull()), lambda xs: F.when(F.size(xs) > 0, F.round(F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs), 6)))

    return F.transform(F.sequence(F.lit(0), F.array_max(F.transform(vectors, F.size)) - 1), one)


def _less_one(w: Column) -> Column:
    return F.when(F.length(w) > 1, F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))).otherwise(F.array().cast("array<string>"))


def reduce_dimensions(df: DataFrame, vector: str, k: int, out: str = "reduced") -> DataFrame:
    """Principal components; signs are fixed so that each component's largest loading is positive."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(rows)
    load = model.pc.toArray()
    sign = np.sign(load[np.abs(load).argmax(axis=0), np.arange(load.shape[1])]).tolist()
    signs = F.array(*[F.lit(float(s)) for s in sign])
    return model.transform(rows).withColumn(out, F.zip_with(vector_to_array("_p"), signs, lambda x, s: x * s)).drop("_v", "_p")


def robust_pca(matrix: np.ndarray, steps: int = 200, tolerance: float = 1e-7) -> tuple[np.ndarray, np.ndarray]:
    """(low rank, sparse) parts of a small matrix by principal component pursuit with alternating directions."""
    mu = matrix.size / (4 * np.abs(matrix).sum() or 1.0)
    lam = 1 / np.sqrt(max(matrix.shape))
    sparse, dual = np.zeros_like(matrix), np.zeros_like(matrix)
    shrink = lambda x, t: np.sign(x) * np.maximum(np.abs(x) - t, 0)
    low = matrix
    for _ in range(steps):
        u, s, v = np.linalg.svd(matrix - sparse + dual / mu, full_matrices=False)
        low = (u * shrink(s, 1 / mu)) @ v
        sparse = shrink(matrix - low + dual / mu, lam / mu)
        rest = matrix - low - sparse
        dual = dual + mu * rest
        if np.linalg.norm(rest) <= tolerance * np.linalg.norm(matrix):
            break
    return low, sparse
