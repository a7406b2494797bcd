"""Reranking of a short list through pluggable providers; a provider that fails leaves the order as it was."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Protocol

HEAD = 20
DOC_BYTES, JUDGE_BYTES = 1000, 800
LOW_EXISTS = 0.30


class Reranker(Protocol):
    def scores(self, query: str, docs: Sequence[str]) -> list[tuple[int, float]]: ...


def cut(text: str, most: int) -> str:
    return text.encode("utf-8")[:most].decode("utf-8", errors="ignore")


def reranked(query: str, hits: list[dict], reranker: Reranker, head: int = HEAD) -> list[dict]:
    """The head by new score (ties by old place), items that the provider left out, then the tail."""
    top, tail = hits[:head], hits[head:]
    docs = [f"{h['breadcrumb']} {cut(h['text'], DOC_BYTES)}" for h in top]
    try:
        found = {i: s for i, s in reranker.scores(query, docs) if 0 <= i < len(top)}
    except Exception as e:
        return [{**h, "note": f"rerank failed: {e}"} for h in hits]
    order = sorted(found, key=lambda i: (-found[i], i))
    return [{**top[i], "score": found[i]} for i in order] + [top[i] for i in range(len(top)) if i not in found] + tail


def parse_scores(body: dict) -> list[tuple[int, float]]:
    """Index and score of a rerank answer; rows without a usable index are ignored."""
    out = [(r.get("index"), r.get("relevance_score", r.get("score"))) for r in body.get("results", [])]
    return sorted(((i, float(s)) for i, s in out if isinstance(i, int) and i >= 0 and s is not None), key=lambda x: (-x[1], x[0]))


def judged(query: str, hits: list[dict], judge: Callable[[str, list[str]], dict[str, float]]) -> tuple[list[dict], dict]:
    """Order by a judge's probabilities (a missing one is 0); status names the chance that any answer exists."""
    docs = [cut(h["text"], JUDGE_BYTES) for h in hits]
    try:
        answer = judge(query, docs)
    except Exception as e:
        return hits, {"mode": "fallback", "note": f"fallback({e})", "exists": None}
    p = [answer.get(str(i), 0.0) for i in range(len(hits))]
    exists = answer.get("exists")
    note = "low confidence" if exists is not None and exists < LOW_EXISTS else ""
    return [{**hits[i], "score": p[i]} for i in sorted(range(len(hits)), key=lambda i: (-p[i], i))], {"mode": "judge", "note": note, "exists": exists}
