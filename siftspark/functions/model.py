"""Calls to an external language model behind a protocol, with an offline stand-in that follows fixed rules."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

from siftspark.functions import lexicons as L


class Model(Protocol):
    """Anything that answers a named task about a text with a JSON object."""

    def complete(self, task: str, text: str) -> str: ...


class RuleModel:
    """Answers by rules, offline and always alike: sentences with a pain keyword become events."""

    def complete(self, task: str, text: str) -> str:
        if task != "extract":
            return json.dumps({"task": task, "summary": text[:200]})
        words = [k for ks in L.PAIN.values() for k in ks]
        events = []
        for sentence in re.split(r"(?<=[.!?])\s+|\n+", text):
            hits = [w for w in words if w in sentence.lower()]
            if hits:
                events.append({"problem": sentence.strip(), "confidence": min(1.0, 0.3 + 0.2 * len(hits)), "mentioned_tools": [t for t in L.TOOLS if t in sentence.lower()]})
        return json.dumps({"pain_events": events})


def repaired(answer: str) -> dict:
    """The JSON object in an answer: the outermost braces, without bold marks, control characters in strings as blanks; else {error, raw}."""
    a, b = answer.find("{"), answer.rfind("}")
    if a >= 0 and b > a:
        for attempt in (answer[a : b + 1], re.sub(r"[\x00-\x1f]", " ", answer[a : b + 1].replace("**", ""))):
            try:
                found = json.loads(attempt)
                if isinstance(found, dict):
                    return found
            except ValueError:
                continue
    return {"error": "no JSON", "raw": answer}


def with_retries(call: Callable[[], str], tries: int = 5, wait: float = 1.0, most: float = 120.0, sleep=time.sleep) -> str:
    """The first answer that does not raise; waits double up to ``most`` seconds; the last failure is raised."""
    for i in range(tries):
        try:
            return call()
        except Exception:
            if i == tries - 1:
                raise
            sleep(min(most, wait * 2**i))
    raise ValueError("tries must be positive")


def extract_events(posts: DataFrame, model: Model) -> DataFrame:
    """(post_id, place, problem, confidence, mentioned_tools) of posts (id, text): what the model extracts, whole texts, a batch at a time.

    A null or blank text is not sent. An answer without events, or one that cannot be repaired, gives none.
    """

    def apply(batches):
        for batch in batches:
            out: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text and text.strip():
                    found = repaired(with_retries(lambda t=text: model.complete("extract", t))).get("pain_events", [])
                    out += [(key, i, str(e.get("problem", "")), float(e.get("confidence", 0)), [str(t) for t in e.get("mentioned_tools", [])]) for i, e in enumerate(found) if isinstance(e, dict)]
            cols = list(zip(*out)) or [()] * 5
            kinds = [pa.string(), pa.int32(), pa.string(), pa.float64(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["post_id", "place", "problem", "confidence", "mentioned_tools"])

    return posts.select("id", "text").mapInArrow(apply, "post_id string, place int, problem string, confidence double, mentioned_tools array<string>")


def hashed_vector(text: str | None, dim: int = 64) -> list[float] | None:
    """An offline stand-in for an embedding: signed hashes of the words, scaled to length 1; None for no words."""
    import math

    import xxhash

    v = [0.0] * dim
    for w in re.findall(r"\w+", text.lower()) if text else ():
        h = xxhash.xxh64_intdigest(w)
        v[h % dim] += 1.0 if h >> 63 else -1.0
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n else None


def embedded(rows: DataFrame, dim: int = 64) -> DataFrame:
    """(id, embedding_vector) of rows (id, text): each distinct text is embedded once; texts without words are skipped."""
    texts = rows.select("text").filter("text IS NOT NULL").distinct()

    def apply(batches):
        for batch in batches:
            got = [hashed_vector(t, dim) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.list_(pa.float32()))], names=["text", "embedding_vector"])

    vectors = texts.mapInArrow(apply, "text string, embedding_vector array<float>").filter("embedding_vector IS NOT NULL")
    return rows.select("id", "text").join(vectors, "text").select("id", "embedding_vector")
