"""Model and text-recognition backends: a protocol run inside partitions, one session a partition; errors become a column."""

from __future__ import annotations

import base64
import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ..sources.config import Vlm


class Backend(Protocol):
    """Anything that completes prompts; opened on the executor."""

    def complete(self, prompt: str) -> str: ...


class Echo:
    """A stub without a model, for tests: repeats the prompt as a title."""

    def complete(self, prompt: str) -> str:
        return json.dumps({"title": prompt[:80]})


class HttpModel:
    """A model served over HTTP, as two public servers do: style "generate" posts {model, prompt, images, options} to /api/generate
    and reads response; "completion" posts {prompt, n_predict, temperature} to /completion and reads content."""

    def __init__(self, model: str, base: str, style: str = "generate", max_tokens: int = 1024, temperature: float = 0.1, timeout: float = 120.0):
        if style not in ("generate", "completion"):
            raise ValueError("a style is generate or completion")
        self.model, self.base, self.style, self.max_tokens, self.temperature, self.timeout = model, base.rstrip("/"), style, max_tokens, temperature, timeout

    def _post(self, path: str, body: dict) -> dict:
        request = urllib.request.Request(self.base + path, json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return json.loads(answer.read())

    def complete(self, prompt: str, image: bytes | None = None) -> str:
        images = [base64.b64encode(image).decode()] if image else []
        if self.style == "generate":
            body = {"model": self.model, "prompt": prompt, "stream": False, "options": {"temperature": self.temperature, "num_predict": self.max_tokens}}
            return self._post("/api/generate", body | ({"images": images} if images else {}))["response"]
        body = {"prompt": prompt, "n_predict": self.max_tokens, "temperature": self.temperature}
        return self._post("/completion", body | ({"image_data": [{"data": images[0], "id": 1}]} if images else {}))["content"]

    def healthy(self) -> bool:
        """Whether the server answers at all."""
        try:
            with urllib.request.urlopen(self.base + ("/api/tags" if self.style == "generate" else "/health"), timeout=5):
                return True
        except OSError:
            return False


class LocalModel:
    """A text model of the transformers library in the process of the task, where that library is installed."""

    def __init__(self, model_id: str, max_tokens: int = 1024):
        from transformers import pipeline  # an optional library

        self.run, self.max_tokens = pipeline("text-generation", model=model_id), max_tokens

    def complete(self, prompt: str) -> str:
        return self.run(prompt, max_new_tokens=self.max_tokens, return_full_text=False)[0]["generated_text"]


def factories(vlm: Vlm) -> list[Callable[[], Backend]]:
    """ML-7: how to open the configured model, then the lighter one; they are opened where the tasks run."""
    if not vlm.enabled:
        return []
    common = {"max_tokens": vlm.max_tokens, "temperature": vlm.temperature, "timeout": vlm.timeout_seconds}
    if vlm.runtime == "llamacpp":
        return [lambda: HttpModel(vlm.model, f"http://127.0.0.1:{vlm.llamacpp_port}", "completion", **common)]
    if vlm.runtime == "transformers":
        return [lambda: LocalModel(vlm.hf_model_id, vlm.max_tokens)]
    if vlm.runtime != "ollama":
        raise ValueError("a runtime is ollama, llamacpp or transformers")
    return [lambda name=name: HttpModel(name, f"http://127.0.0.1:{vlm.ollama_port}", **common) for name in dict.fromkeys([vlm.model, vlm.fallback_model]) if name]


class Fallback:
    """The first backend that opens and answers; health is the name of the one in use."""

    def __init__(self, factories: list[Callable[[], Backend]]):
        self.backends = []
        for make in factories:
            try:
                self.backends.append(make())
            except Exception:  # noqa: BLE001 - a backend that does not open is skipped
                continue
        self.health = type(self.backends[0]).__name__ if self.backends else "none"

    def complete(self, prompt: str) -> str:
        error: Exception | None = None
        for b in self.backends:
            try:
                return b.complete(prompt)
            except Exception as e:  # noqa: BLE001 - the next backend is tried
                error = e
        raise RuntimeError(f"no backend answered: {error}")


def completed(df: DataFrame, key: str, prompt: str, factories: list[Callable[[], Backend]]) -> DataFrame:
    """ML-5, SCH-3: key, response, error, duration_ms for each row of df; a failed row has a null response and its error."""
    ship(df.sparkSession)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = Fallback(factories)
        for pdf in batches:
            rows = []
            for k, p in zip(pdf[key], pdf[prompt]):
                begun = time.monotonic()
                try:
                    answer, error = backend.complete(p), None
                except Exception as e:  # noqa: BLE001 - reported in the row
                    answer, error = None, str(e)
                rows.append((k, answer, error, int((time.monotonic() - begun) * 1000)))
            yield pd.DataFrame(rows, columns=[key, "response", "error", "duration_ms"])

    return df.select(key, prompt).mapInPandas(ask, f"{key} {dict(df.dtypes)[key]}, response string, error string, duration_ms bigint")


# What a prompt asks for, and the fields of the answer.
FIELD_PROMPT = "Read the first page of this document and answer with one JSON object with the keys title, author, organization, date (YYYY-MM-DD), report_id, document_type, keywords and summary. Use null for what the page does not say."
NAME_PROMPT = "Suggest one short descriptive file name for this document, in lower case, words parted by underscores, without an ending. Answer with the name alone."


def with_prompt(df: DataFrame, known: dict[str, str], original: str, text: str = FIELD_PROMPT, out: str = "prompt") -> DataFrame:
    """ML-6: add the prompt of each row: the text, what is already known (label -> column) and the original file name; empty values are left out."""
    lines = [F.when(F.trim(c) != "", F.concat(F.lit(f"{label}: "), F.col(c))) for label, c in known.items()]
    lines.append(F.when(F.trim(original) != "", F.concat(F.lit("Original file name: "), F.col(original))))
    return df.withColumn(out, F.concat_ws("\n", F.lit(text), *lines))
