"""Embedding and language-model providers: what a provider is, and deterministic stand-ins that need no network."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable

import numpy as np

MAX_TOKENS = 2048


def hashing_embed(texts: list[str], size: int = 64) -> list[list[float]]:
    """Unit vectors from hashed words: equal texts have equal vectors, shared words make likeness."""
    out = []
    for text in texts:
        v = np.zeros(size)
        for word in re.findall(r"\w+", text.lower()) or [""]:
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            v[h % size] += 1 if h >> 32 & 1 else -1
        n = np.linalg.norm(v)
        out.append((v / n if n else np.eye(size)[0]).astype(np.float32).tolist())
    return out


def count_tokens(texts: list[str]) -> list[int]:
    return [len(re.findall(r"\w+|[^\w\s]", t)) for t in texts]


def with_schema_prompt(messages: list[dict], schema: str) -> list[dict]:
    """For providers without structured output: the schema goes first, as a system message."""
    return [{"role": "system", "content": f"JSON schema of the reply:\n{schema}"}, *messages]


def retried(call: Callable[[], str], tries: int = 3, longest: float = 30.0, sleep: Callable[[float], None] | None = None) -> str:
    """Calls again after errors marked `retry` (rate limits, server errors), waiting as told or 2**n seconds."""
    for n in range(tries):
        try:
            return call()
        except ProviderError as e:
            if not e.retry or n == tries - 1:
                raise
            (sleep or __import__("time").sleep)(min(e.after if e.after is not None else 2.0**n, longest))
    raise AssertionError


def guarded(chat: Callable[[str, str], str], retries: int, most_errors: int) -> Callable[[str, str], tuple[str | None, str | None, int]]:
    """ask(system, user) -> (reply, error, calls). A failed call is repeated up to retries times; after most_errors provider
    errors in a row nothing is called any more. A reply that cannot be read (ValueError) shows that the provider answers."""
    streak = 0

    def ask(system: str, user: str) -> tuple[str | None, str | None, int]:
        nonlocal streak
        error = "stopped"
        for n in range(retries + 1):
            if streak >= most_errors:
                return None, error, n
            try:
                reply = chat(system, user)
                streak = 0
                return reply, None, n + 1
            except ValueError as e:
                streak, error = 0, f"ValueError: {e}"[:400]
            except Exception as e:
                streak, error = streak + 1, f"{type(e).__name__}: {e}"[:400]
        return None, error, retries + 1

    return ask


def again_on_schema_errors(call: Callable[[], str], tries: int = 2) -> str:
    """Calls again only after errors of code "schema" (a reply that the provider's own check refused)."""
    for n in range(tries):
        try:
            return call()
        except ProviderError as e:
            if e.code != "schema" or n == tries - 1:
                raise
    raise AssertionError


def structured(request: dict, schema: dict, mode: str) -> dict:
    """A chat request that asks for JSON of a schema, in the way a provider takes it.

    strict and json_schema: as a response format; guided: as an extension; format: as a field of its own; prompt: as a system
    message, for models that know none of these.
    """
    if mode in ("strict", "json_schema"):
        return request | {"response_format": {"type": "json_schema", "json_schema": {"name": "reply", "schema": schema, **({"strict": True} if mode == "strict" else {})}}}
    if mode == "guided":
        return request | {"nvext": {"guided_json": schema}}
    if mode == "format":
        return request | {"format": schema}
    if mode == "prompt":
        return request | {"messages": with_schema_prompt(request["messages"], json.dumps(schema, ensure_ascii=False))}
    raise ValueError(f"unknown mode {mode!r}")


def said(reply: str, finish: str | None = None) -> tuple[str, bool]:
    """(text without its thinking part, whether it was cut at the length limit)."""
    return re.sub(r"(?s)<think>.*?</think>", "", reply).strip(), finish == "length"


class ProviderError(Exception):
    def __init__(self, message: str, code: str = "api", retry: bool = False, after: float | None = None):
        super().__init__(message)
        self.code, self.retry, self.after = code, retry, after


PROVIDERS: dict[str, Callable[[list[dict]], str]] = {}


def provider(name: str | None = None) -> Callable[[list[dict]], str]:
    """A registered chat function, by name or by the variable LLM_PROVIDER."""
    name = name or os.environ.get("LLM_PROVIDER", "")
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider {name!r}; registered: {sorted(PROVIDERS)}")
    return PROVIDERS[name]


def model_limit(model: str, limits: dict[str, int], default: int = 200) -> int:
    """Output tokens for the first prefix that fits."""
    return next((n for p, n in limits.items() if model.startswith(p)), default)
