"""Requests, user-supplied models over prompts, and responses."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from textloom.functions import strip_text, truncate, words

# The request parameters, their types and what they are if not given.
DEFAULTS: dict[str, tuple[str, object]] = {
    "max_new_tokens": ("int", 128),
    "temperature": ("double", 1.0),
    "top_p": ("double", 0.9),
    "top_k": ("int", 50),
    "num_return_sequences": ("int", 1),
}

Generator = Callable[[list[str], list[dict]], Sequence[Sequence[str]]]
_loaded: dict[str, Generator] = {}


def with_defaults(df: DataFrame) -> DataFrame:
    """Every request parameter as a typed column, defaults where it is missing or null."""
    return df.withColumns(
        {
            name: F.coalesce(F.col(name).cast(kind), F.lit(default).cast(kind)) if name in df.columns
            else F.lit(default).cast(kind)
            for name, (kind, default) in DEFAULTS.items()
        }
    )


def parse_requests(df: DataFrame, body: str, fields: str | None = None) -> DataFrame:
    """JSON request bodies to typed columns with defaults, and ``request_error``, null for a good request.

    A body has to be an object with a text as ``prompt``; whole numbers and numbers may be written as texts, and a null
    counts as left out. Whatever breaks this is named in ``request_error``, and all parameters are defaults then.
    ``fields`` reads other fields (DDL) instead of ``prompt``, without checks.
    """
    # two passes over a body, however many fields it has: a strict one, for its form and the prompt, and one for the texts
    # of the parameters, which are checked as numbers
    parsed = df.withColumn("__v", F.try_parse_json(body)).withColumn("__p", F.try_variant_get("__v", "$.prompt", "variant"))
    parsed = parsed.withColumn("__k", F.schema_of_variant("__p"))
    parsed = parsed.withColumn("__t", F.from_json(body, ", ".join(f"{name} string" for name in DEFAULTS)))
    opened = F.col("__v").isNotNull() & F.ltrim(body, F.lit(" \n\r\t")).startswith("{")
    problems = [F.when(~F.coalesce(opened, F.lit(False)), "body is not a JSON object")]
    values = {}
    if fields is None:
        values["prompt"] = F.when(F.col("__k") == "STRING", F.try_variant_get("__p", "$", "string"))
        missing = F.col("__k").isNull() | (F.col("__k") == "VOID")
        problems.append(F.when(missing, "prompt is missing").when(F.col("__k") != "STRING", "prompt is not a text"))
    parsed = parsed.withColumns({f"__n_{n}": F.col(f"__t.{n}").try_cast("double") for n in DEFAULTS})
    for name, (kind, _) in DEFAULTS.items():
        number = F.col(f"__n_{name}")
        plain = number.isNotNull() & ~F.isnan(number)
        if kind == "int":
            plain = plain & (number == F.floor(number)) & (F.abs(number) < 2**31)
        values[name] = F.when(plain, number.cast(kind))
        wanted = "a whole number" if kind == "int" else "a number"
        given = F.col(f"__t.{name}").isNotNull()
        problems.append(F.when(given & ~F.coalesce(plain, F.lit(False)), f"{name} is not {wanted}"))
    parsed = parsed.withColumn("request_error", F.coalesce(*problems))
    good = F.col("request_error").isNull()
    parsed = parsed.withColumns({name: F.when(good | F.lit(name == "prompt"), value) for name, value in values.items()})
    parsed = parsed.drop("__p", "__k", "__t", *[f"__n_{name}" for name in DEFAULTS])
    if fields is not None:
        parsed = parsed.withColumn("__f", F.from_json(body, fields)).select("*", "__f.*").drop("__f")
    return with_defaults(parsed.drop("__v"))


def parameters() -> Column:
    return F.struct(*[F.col(name) for name in DEFAULTS])


def to_response(df: DataFrame, texts: str = "generated_texts", prompt: str = "prompt") -> DataFrame:
    """Echo the prompt and the five parameters next to the texts; other columns stay in front."""
    dropped = [c for c in df.columns if c not in DEFAULTS and c not in (texts, prompt)]
    return df.select(
        *dropped,
        F.col(prompt).alias("prompt"),
        F.col(texts).alias("generated_texts"),
        parameters().alias("parameters"),
    )


def without_prompt(full: Column, prompt: Column) -> Column:
    """Cut as many leading characters as the prompt has, then strip."""
    return strip_text(full.substr(F.length(prompt) + 1, F.length(full)))


def expand_sequences(df: DataFrame, n: str = "num_return_sequences") -> DataFrame:
    """One row per sequence to return, numbered from 1."""
    return df.withColumn("seq", F.explode(F.sequence(F.lit(1), F.col(n))))


def collect_sequences(df: DataFrame, key: list[str], text: str = "text", n: str = "seq") -> DataFrame:
    """The texts of each key as one array in sequence order; as long as the number of sequences asked for."""
    ordered = F.array_sort(F.collect_list(F.struct(n, text)))
    return df.groupBy(*key).agg(F.transform(ordered, lambda x: x[text]).alias("generated_texts"))


def predict(make_predict: Callable, return_type: DataType, *inputs: Column, batch_size: int = 8) -> Column:
    """Column of a user model: loaded once per Python worker, called on batches, one value per row."""
    return predict_batch_udf(make_predict, return_type=return_type, batch_size=batch_size)(*inputs)


def length_batches(sizes: Sequence[int], budget: int) -> list[int]:
    """Ends of batches of rows that come by rising size: each as many rows as fit ``budget`` when padded to its longest,
    and one row at least."""
    ends, start = [], 0
    for i, size in enumerate(sizes):
        if i > start and (i - start + 1) * size > budget:
            ends.append(i)
            start = i
    return [*ends, len(sizes)] if len(sizes) else []


def padding_report(generated: DataFrame) -> DataFrame:
    """One row out of ``generate`` with a token budget: prompts, their tokens, tokens with padding, and padding's share."""
    sums = generated.where(F.col("padded_to").isNotNull()).agg(
        F.count(F.lit(1)).alias("prompts"),
        F.sum("prompt_tokens").alias("tokens"),
        F.sum(F.col("padded_to").cast("long")).alias("padded"),
    )
    return sums.withColumn("pad_share", 1 - F.col("tokens") / F.nullif("padded", F.lit(0)))


def generate(
    df: DataFrame,
    make_generator: Callable[[], Generator],
    prompt: str = "prompt",
    batch_size: int = 8,
    max_length: int | None = None,
    settings: Sequence[str] = (),
    token_budget: int | None = None,
) -> DataFrame:
    """Add ``generated_texts``, ``status`` and ``error`` by a user-supplied text model.

    ``make_generator()`` runs once per Python worker. What it returns takes up to ``batch_size`` prompts and their
    parameters and returns, per prompt, the full texts with the prompt in front. If a batch fails its prompts are tried
    one by one, so that only the bad ones become errors. Rows stay where they are: no shuffle. ``settings`` names
    further columns that the model gets with the parameters.

    With ``token_budget`` prompts of similar length share a batch: rows are shuffled once into ranges of their number of
    words, prompts of one length being dealt out over several tasks if they are many, and a batch holds as many as the
    budget allows when all are padded to the longest, instead of ``batch_size``. ``prompt_tokens`` and ``padded_to`` tell
    what that took, see ``padding_report``; the order of the prompts is that of a key of theirs, by which
    ``write_results`` sorts.

    A row with a null prompt, or with a ``request_error`` from ``parse_requests``, never reaches the model and has that
    error.

    With ``max_length`` a longer prompt is handed over as its first ``max_length`` words, and that is what is cut off
    the front of the answer; the prompt column itself stays whole.
    """
    name = uuid.uuid4().hex

    @F.pandas_udf("struct<texts: array<string>, error: string, padded_to: int>")
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # imported here, so that it is the worker's own and outlives the task
        from textloom.operators.generation import _loaded

        if name not in _loaded:
            _loaded.clear()  # a reused worker keeps the latest model only
            _loaded[name] = make_generator()
        model = _loaded[name]

        def one_by_one(prompts: list[str], settings: list[dict]) -> list[tuple]:
            rows: list[tuple] = []
            for text, setting in zip(prompts, settings):
                try:
                    rows.append((list(model([text], [setting])[0]), None))
                except Exception as problem:  # noqa: BLE001 - any failure becomes that row's error
                    rows.append((None, f"model failed: {problem}"))
            return rows

        def whole(prompts: list[str], settings: list[dict]) -> list[tuple]:
            try:
                texts = model(prompts, settings)
                if len(texts) != len(prompts):
                    raise ValueError(f"{len(texts)} results for {len(prompts)} prompts")
                return [(list(t), None) for t in texts]
            except Exception:  # noqa: BLE001
                return one_by_one(prompts, settings)

        for frame in frames:
            refused = frame["refused"].tolist()
            out: list[tuple] = [(None, r, None) for r in refused]
            good = [i for i, r in enumerate(refused) if r is None]
            sizes = frame["size"].tolist()
            prompts, rows = frame["prompt"].tolist(), frame.drop(columns=["prompt", "refused", "size"]).to_dict("records")
            ends = list(range(batch_size, len(good) + batch_size, batch_size))
            if token_budget is not None:
                ends = length_batches([sizes[i] for i in good], token_budget)
            for start, end in zip([0, *ends], ends):
                part = good[start:end]
                longest = max(sizes[i] for i in part) if token_budget is not None else None
                for i, answer in zip(part, whole([prompts[i] for i in part], [rows[i] for i in part])):
                    out[i] = (*answer, longest)
            yield pd.DataFrame(out, columns=["texts", "error", "padded_to"]).astype({"padded_to": "Int32"})

    handed = F.col(prompt)
    if max_length is not None:
        start = words(handed, max_length + 1)
        handed = F.when(F.size(start) > max_length, F.concat_ws(" ", truncate(start, max_length))).otherwise(handed)
    refused = F.when(F.col("__prompt").isNull(), F.lit("prompt is missing"))
    if "request_error" in df.columns:
        refused = F.coalesce("request_error", refused)
    ready = with_defaults(df.withColumn("__prompt", handed))
    size = F.lit(0)
    if token_budget is not None:
        if token_budget < 1:
            raise ValueError("token_budget must be at least 1")
        counted = F.when(F.col("__prompt").isNotNull(), F.size(words(F.col("__prompt")))).otherwise(F.lit(0))
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ready = ready.withColumn("prompt_tokens", counted)
        ready = ready.repartitionByRange(parts, "prompt_tokens", F.xxhash64("__prompt")).sortWithinPartitions("prompt_tokens")
        size = F.col("prompt_tokens")
    asked = F.struct(
        F.col("__prompt").alias("prompt"), refused.alias("refused"), size.alias("size"),
        *[F.col(p) for p in (*DEFAULTS, *settings)],
    )
    answered = ready.withColumn("__out", run(asked))
    if token_budget is not None:
        answered = answered.withColumn("padded_to", F.col("__out.padded_to"))
    trimmed = F.transform("__out.texts", lambda full: without_prompt(full, F.col("__prompt")))
    return (
        answered.withColumn("generated_texts", trimmed)
        .withColumn("error", F.col("__out.error"))
        .withColumn("status", F.when(F.col("error").isNull(), "ok").otherwise("error"))
        .drop("__out", "__prompt", "request_error")
    )
