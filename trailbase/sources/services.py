"""Outside services behind plain callables: chat models and embedders, with budgets and retries.

Nothing here opens a connection.  ``post`` is whatever talks to the service;
tests give stubs.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass


class BudgetExceededError(RuntimeError):
    """The token budget of a run is used up."""


@dataclass
class TokenBudget:
    """Tokens in and out of one task's calls; a limit of 0 is none."""

    limit: int = 0
    tokens_in: int = 0
    tokens_out: int = 0
    calls: int = 0

    @property
    def total(self) -> int:
        return self.tokens_in + self.tokens_out

    def record(self, tokens_in: int, tokens_out: int) -> None:
        self.tokens_in, self.tokens_out, self.calls = self.tokens_in + tokens_in, self.tokens_out + tokens_out, self.calls + 1

    def check(self) -> None:
        if self.limit and self.total >= self.limit:
            raise BudgetExceededError(f"{self.total} of {self.limit} tokens")


class Chat:
    """A model: prompt in, text out.  post(prompt) gives (text, tokens in, tokens out)."""

    def __init__(self, post: Callable[[str], tuple[str, int, int]], budget: TokenBudget | None = None, retries: int = 2, sleep: Callable[[float], None] = time.sleep):
        self.post, self.budget, self.retries, self.sleep = post, budget or TokenBudget(), retries, sleep

    def __call__(self, prompt: str) -> str:
        for attempt in range(self.retries + 1):
            self.budget.check()
            try:
                text, tokens_in, tokens_out = self.post(prompt)
            except OSError:
                if attempt == self.retries:
                    raise
                self.sleep(2.0**attempt)
                continue
            self.budget.record(tokens_in, tokens_out)
            return text
        raise AssertionError


def remote_embedder(post: Callable[[list[str]], list[dict]], most: int = 100, retries: int = 2, sleep: Callable[[float], None] = time.sleep) -> Callable[[list[str]], list[list[float]]]:
    """An embedder over a service that answers {"index", "embedding"} in any order, ``most`` texts at a time."""

    def embed(texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for low in range(0, len(texts), most):
            for attempt in range(retries + 1):
                try:
                    answer = post(texts[low : low + most])
                    break
                except OSError:
                    if attempt == retries:
                        raise
                    sleep(2.0**attempt)
            out += [a["embedding"] for a in sorted(answer, key=lambda a: a["index"])]
        return out

    return embed
