"""Proposing a plan: one call of a completion provider for each file.

A provider is anything with complete(system, user) -> text.  It sees profiles,
never rows.  NameProposer answers without a model, from the names alone.
"""

from __future__ import annotations

import difflib
import json
import os
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from mergeloom.operators.entity import Embedder, hashed_ngrams, http_embedder, strip_fence
from mergeloom.plans.contracts import Mapping, MappingEntry, SourceMatch, TargetSchema
from mergeloom.plans.guards import name_tokens

AUTO_CONFIDENCE = 0.85
PROMPT_SAMPLES = 10
SYSTEM = (
    "Match target columns to source columns of one file. Tables are only stacked, never joined. Use null where nothing fits. "
    "Give a low confidence where a total would fill a price of one item, or one item's price a total, and where a name or its samples "
    "show a currency other than the target's. "
    'Answer with JSON only: {"matches": [{"target_column": "...", "source_column": "..." or null, "confidence": 0 to 1, "reason": "..."}]}.'
)


class Completer(Protocol):
    def complete(self, system: str, user: str) -> str: ...


@dataclass
class FileProfile:
    """file: its name; columns: rows of profile_table, of all its tables, the first of a name winning."""

    file: str
    columns: list[dict]

    def samples(self) -> dict[tuple[str, str], list]:
        out: dict[tuple[str, str], list] = {}
        for c in self.columns:
            out.setdefault((self.file, c["name"]), list(c["samples"] or []))
        return out


def prompt(profile: FileProfile, schema: TargetSchema) -> str:
    keep = ("name", "inferred_type", "unique_count", "null_ratio", "min", "max", "format_pattern")
    columns = [{k: c[k] for k in keep} | {"samples": list(c["samples"] or [])[:PROMPT_SAMPLES]} for c in profile.columns]
    targets = [{"name": c.name, "type": c.type, "required": c.required} for c in schema.columns]
    return json.dumps({"file": profile.file, "target_columns": targets, "source_columns": columns}, ensure_ascii=False, default=str)


def read_answer(answer: str, schema: TargetSchema, columns: set[str]) -> dict[str, tuple[str | None, float, str]] | None:
    """Target -> (column, confidence, reason) of the well-formed matches; None if the answer is no JSON."""
    try:
        rows = json.loads(strip_fence(answer))
    except ValueError:
        return None
    rows = rows.get("matches", []) if isinstance(rows, dict) else rows
    out: dict[str, tuple[str | None, float, str]] = {}
    for r in rows if isinstance(rows, list) else []:
        if not isinstance(r, dict):
            continue
        target, column, confidence, reason = (r.get(k) for k in ("target_column", "source_column", "confidence", "reason"))
        number = isinstance(confidence, (int, float)) and not isinstance(confidence, bool) and 0 <= confidence <= 1
        if target in schema.names and target not in out and (column is None or column in columns) and number and isinstance(reason, str) and reason.strip():
            out[target] = (column, float(confidence), reason)
    return out


def propose(profiles: list[FileProfile], schema: TargetSchema, provider: Completer, auto: float = AUTO_CONFIDENCE) -> Mapping:
    if not 0 <= auto <= 1:
        raise ValueError("the auto confidence must be from 0 to 1")
    by_target: dict[str, list[SourceMatch]] = {t: [] for t in schema.names}
    for p in profiles:
        samples = p.samples()
        found = read_answer(provider.complete(SYSTEM, prompt(p, schema)), schema, {c["name"] for c in p.columns})
        for t in schema.names:
            column, confidence, reason = (found or {}).get(t, (None, 0.0, "the provider gave no usable answer"))
            if found is None or t not in found:
                match = SourceMatch(p.file, None, 0.0, "review", reason)
            elif column is None:
                match = SourceMatch(p.file, None, confidence, "unmatched", reason)
            else:
                sure = confidence >= auto
                match = SourceMatch(p.file, column, confidence, "auto" if sure else "review", reason, None if sure else samples[(p.file, column)][:PROMPT_SAMPLES])
            by_target[t].append(match)
    return Mapping([MappingEntry(t, m) for t, m in by_target.items()])


class FakeProvider:
    """Gives set answers in turn, and notes what it was asked."""

    def __init__(self, *answers: str):
        self.answers, self.calls = list(answers), []

    def complete(self, system: str, user: str) -> str:
        self.calls.append((system, user))
        return self.answers[min(len(self.calls), len(self.answers)) - 1]


class NameProposer:
    """Matches by likeness of names and agreement of types."""

    def complete(self, system: str, user: str) -> str:
        asked = json.loads(user)
        out = []
        for t in asked["target_columns"]:
            words = name_tokens(t["name"])
            best = (0.0, None)
            for c in asked["source_columns"]:
                other = name_tokens(c["name"])
                shared = len(set(words) & set(other)) / max(1, len(set(words) | set(other)))
                alike = max(shared, difflib.SequenceMatcher(None, " ".join(words), " ".join(other)).ratio())
                fits = t["type"] in ("string", c["inferred_type"]) or (t["type"] == "decimal" and c["inferred_type"] == "integer")
                best = max(best, (alike if fits else alike / 2, c["name"]), key=lambda x: x[0])
            named = best[1] if best[0] >= 0.4 else None
            out.append({"target_column": t["name"], "source_column": named, "confidence": round(best[0], 3), "reason": "by name"})
        return json.dumps({"matches": out}, ensure_ascii=False)


class HttpProvider:
    """A chat endpoint over HTTP: url and headers, a body from (model, system, user), and the text out of the answer."""

    def __init__(self, url: str, headers: dict[str, str], body: Callable[[str, str], dict], text: Callable[[dict], str], timeout: float = 120):
        self.url, self.headers, self.body, self.text, self.timeout = url, headers, body, text, timeout

    def complete(self, system: str, user: str) -> str:
        data = json.dumps(self.body(system, user)).encode()
        request = urllib.request.Request(self.url, data, self.headers | {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return self.text(json.load(answer))
        except (OSError, ValueError, KeyError, IndexError) as e:
            raise ProviderError(f"{self.url}: {e}{hint(e)}") from e


class ProviderError(ValueError):
    """A provider that could not be reached, or refused."""


#: What to do about an answer's status.
_HINTS = {401: "the key is not valid", 403: "the key may not use this model", 404: "there is no such model, or the key may not use it", 429: "too many requests; try again later"}


def hint(e: Exception) -> str:
    if isinstance(e, urllib.error.HTTPError):
        return f" ({_HINTS[e.code]})" if e.code in _HINTS else ""
    return " (no connection)" if isinstance(e, OSError) else " (not the answer of such an endpoint)"


def provider_from_environment(env: dict[str, str] | None = None) -> Completer:
    """LLM_PROVIDER names openai, anthropic or ollama, with LLM_MODEL and LLM_API_KEY; without it, names decide."""
    env = dict(os.environ) if env is None else env
    kind, model, key = env.get("LLM_PROVIDER", ""), env.get("LLM_MODEL", ""), env.get("LLM_API_KEY", "")
    chat = lambda s, u: [{"role": "system", "content": s}, {"role": "user", "content": u}]
    if not kind:
        return NameProposer()
    if not model:
        raise ValueError("set LLM_MODEL")
    if kind == "ollama":
        return HttpProvider(env.get("LLM_URL", "http://localhost:11434") + "/api/chat", {}, lambda s, u: {"model": model, "messages": chat(s, u), "stream": False}, lambda a: a["message"]["content"])
    if not key:
        raise ValueError("set LLM_API_KEY")
    if kind == "openai":
        return HttpProvider("https://api.openai.com/v1/chat/completions", {"Authorization": f"Bearer {key}"}, lambda s, u: {"model": model, "messages": chat(s, u)}, lambda a: a["choices"][0]["message"]["content"])
    if kind == "anthropic":
        headers = {"x-api-key": key, "anthropic-version": "2023-06-01"}
        return HttpProvider("https://api.anthropic.com/v1/messages", headers, lambda s, u: {"model": model, "max_tokens": 4096, "system": s, "messages": chat(s, u)[1:]}, lambda a: a["content"][0]["text"])
    raise ValueError(f"unknown provider {kind!r}")


def embedder_from_environment(env: dict[str, str] | None = None) -> Embedder:
    """The endpoint that EMBED_URL names, with EMBED_MODEL and LLM_API_KEY; without it, hashed n-grams."""
    env = dict(os.environ) if env is None else env
    if not env.get("EMBED_URL"):
        return hashed_ngrams
    if not env.get("EMBED_MODEL"):
        raise ValueError("set EMBED_MODEL")
    return http_embedder(env["EMBED_URL"], env["EMBED_MODEL"], env.get("LLM_API_KEY"))
