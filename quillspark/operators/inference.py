"""Plug-in recognizers and translators run as batch jobs: each distinct input once, misses of a cache only.

A plug-in takes a list of texts and returns one for each. It is called with lists of bounded size; a list that fails is
halved until the texts that fail stand alone, so that one bad text costs a few calls and no other text its result."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.segmentation import WHITE

#: A plug-in: texts to texts.
Model = Callable[[list[str]], list[str]]
#: Name -> factory; the factory runs once per task.
REGISTRY: dict[str, Callable[[], Model]] = {}
FAILURE = "[Translation"
TRIES = 3
#: Texts and characters of one call; a longer text is a call of its own.
CALL_TEXTS, CALL_CHARS = 256, 1 << 16


def register(name: str) -> Callable[[Callable[[], Model]], Callable[[], Model]]:
    def add(factory: Callable[[], Model]) -> Callable[[], Model]:
        REGISTRY[name] = factory
        return factory

    return add


def one_by_one(factory: Callable[[], Callable[[str], str]]) -> Callable[[], Model]:
    """A plug-in of a function that takes one text."""

    def made() -> Model:
        one = factory()
        return lambda texts: [one(t) for t in texts]

    return made


@register("first60")
def _first60() -> Model:
    """Stub recognizer: sees the first 60 characters."""
    return lambda texts: [t[:60] for t in texts]


@register("reverse")
def _reverse() -> Model:
    """Stub translator: reverses texts and fails on those that begin with z."""

    def translate(texts: list[str]) -> list[str]:
        if any(t[:1] in ("z", "Z") for t in texts):
            raise ValueError("no translation")
        return [t[::-1] for t in texts]

    return translate


def call(model: Model, texts: list[str], tries: int = 1) -> list[tuple[str, str | None]]:
    """``(result, error)`` of each text. A list that fails is halved; a text alone is tried ``tries`` times."""
    try:
        found = model(texts)
        if len(found) != len(texts):
            raise ValueError(f"{len(found)} results for {len(texts)} texts")
        return [(x, None) for x in found]
    except Exception as e:  # the policy: a failed row is a row
        if len(texts) > 1:
            half = len(texts) // 2
            return call(model, texts[:half], tries) + call(model, texts[half:], tries)
        return call(model, texts, tries - 1) if tries > 1 else [("", str(e))]


def call_in_lists(model: Model, texts: list[str], tries: int = 1) -> list[tuple[str, str | None]]:
    """``call`` on lists of bounded size, in order."""
    out, start, held = [], 0, 0
    for i, t in enumerate(texts):
        if i > start and (i - start >= CALL_TEXTS or held + len(t) > CALL_CHARS):
            out += call(model, texts[start:i], tries)
            start, held = i, 0
        held += len(t)
    return out + (call(model, texts[start:], tries) if start < len(texts) else [])


def factory_of(name: str) -> Callable[[], Model]:
    if name not in REGISTRY:
        raise ValueError(f"unknown model {name!r}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name]


def batch_infer(rows: DataFrame, model: str, column: str = "text") -> DataFrame:
    """Add ``prediction`` and ``error``: an exception gives an empty prediction and its message."""
    factory = factory_of(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model_ = factory()
        for frame in frames:
            found = call_in_lists(model_, frame[column].tolist())
            yield frame.assign(prediction=[f[0] for f in found], error=[f[1] for f in found])

    return rows.mapInPandas(run, f"{_kinds(rows)}, prediction string, error string")


def _kinds(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)


def translate_texts(factory: Callable[[], Model]) -> Callable[[list[str]], list[str]]:
    """A function for one task: translations of texts; after ``TRIES`` failures a text that begins ``[Translation``."""
    translate = factory()
    return lambda texts: [x if e is None else f"{FAILURE} failed: {e}]" for x, e in call_in_lists(translate, texts, TRIES)]


def translate_misses(texts: DataFrame, model: str) -> DataFrame:
    """``text, translation`` for distinct texts."""
    factory = factory_of(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        translate = translate_texts(factory)
        for frame in frames:
            yield pd.DataFrame({"text": frame["text"], "translation": translate(frame["text"].tolist())})

    return texts.select("text").distinct().mapInPandas(run, "text string, translation string")


def with_cache(rows: DataFrame, memory: DataFrame, model: str) -> DataFrame:
    """``text, translation, hit`` for each distinct text: from memory, or translated if it is not there."""
    factory = factory_of(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        translate = translate_texts(factory)
        for frame in frames:
            missed = ~frame["hit"]
            frame.loc[missed, "translation"] = translate(frame.loc[missed, "text"].tolist())
            yield frame

    known = memory.select("text", "translation", F.lit(True).alias("hit"))
    found = rows.select("text").distinct().join(known, "text", "left")  # hits and misses of one join: what they come from is read once
    return found.select("text", "translation", F.coalesce("hit", F.lit(False)).alias("hit")).mapInPandas(run, "text string, translation string, hit boolean")


def latest(rows: DataFrame, key: str, value: Column | str, order: Column | str) -> DataFrame:
    """Last write wins per key."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value if isinstance(value, str) else "value"))


def predict_split(rows: DataFrame, model: str, text: str = "reference", segments: str = "segments") -> DataFrame:
    """Add ``prediction`` of the whole text and ``split_prediction``, its segments' predictions joined again in order (for
    rows of one segment the whole text's). Texts and segments of a batch of rows go to the model together; no row leaves
    its place. A failed call leaves its part empty."""
    factory = factory_of(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model_ = factory()
        for frame in frames:
            parts = [list(p) if p is not None and len(p) > 1 else [] for p in frame[segments]]
            found = [x for x, _ in call_in_lists(model_, frame[text].tolist() + [p for own in parts for p in own])]
            whole, at, split = found[: len(frame)], len(frame), []
            for own, all_ in zip(parts, whole, strict=True):
                split.append(" ".join(x for x in (f.strip(WHITE) for f in found[at : at + len(own)]) if x) if own else all_)
                at += len(own)
            yield frame.assign(prediction=whole, split_prediction=split)

    return rows.mapInPandas(run, f"{_kinds(rows)}, prediction string, split_prediction string")
