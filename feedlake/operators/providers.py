"""What the callers of remote models share: settings from the environment, errors, and the parsing of replies."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, field

#: Statuses of HTTP that may pass.
RETRY_STATUS = (408, 429, 500, 502, 503, 504)
#: Codes of failures and whether trying again may help; an HTTP error says so by its status.
CODES = {"provider_disabled": False, "configuration_error": False, "timeout": True, "rate_limited": True, "http_error": False, "validation_error": False, "invalid_response": False, "short_response": False, "invalid_candidates": False}


class ProviderError(Exception):
    """A provider's failure: code, whether a retry may help, HTTP status and the wait it asked for."""

    def __init__(self, code: str, message: str = "", retryable: bool = False, status: int | None = None, retry_after_ms: int | None = None):
        super().__init__(message or code)
        self.code, self.status, self.retry_after_ms = code, status, retry_after_ms
        self.retryable = retryable or CODES.get(code, False) or status in RETRY_STATUS


@dataclass(frozen=True)
class Profile:
    """What is fixed for one kind of provider: its model (None: any), where it is, and the whole numbers that may be set,
    each as (default, least, most or None)."""

    model: str | None
    base_url: str
    numbers: Mapping[str, tuple[int, int, int | None]]
    fixed: Mapping[str, int] = field(default_factory=dict)


_CALLS = {"timeout_ms": (30_000, 1, None), "max_retries": (2, 0, None)}
#: Fixed values of the three kinds.
EMBEDDING = Profile("nvidia/llama-nemotron-embed-1b-v2", "https://integrate.api.nvidia.com/v1", {**_CALLS, "batch_size": (16, 1, 64), "dimensions": (1024, 1, None)}, {"dimensions": 1024})
RERANKING = Profile("nvidia/llama-nemotron-rerank-1b-v2", "https://ai.api.nvidia.com/v1", {"timeout_ms": (30_000, 100, 120_000), "max_retries": (2, 0, 5), "candidate_limit": (30, 1, 30), "result_limit": (10, 1, 10)})
RELEVANCE = Profile(None, "https://integrate.api.nvidia.com/v1", _CALLS)


@dataclass(frozen=True)
class Settings:
    enabled: bool
    api_key: str | None
    model: str | None
    base_url: str
    numbers: Mapping[str, int]

    def __repr__(self) -> str:  # a key is never shown
        return f"Settings(enabled={self.enabled}, api_key={'***' if self.api_key else None}, model={self.model!r}, base_url={self.base_url!r}, numbers={dict(self.numbers)})"


def settings(env: Mapping[str, str], prefix: str, profile: Profile, shared_key: str = "API_KEY") -> Settings:
    """The settings named PREFIX_ENABLED, PREFIX_API_KEY (else shared_key), PREFIX_MODEL, PREFIX_BASE_URL and PREFIX_<NUMBER>.

    Off unless ENABLED is "true". Numbers are checked even when it is off; a key, and a model where none is fixed, are only
    asked for when it is on. Anything out of bounds is a configuration_error.
    """
    given = lambda name: (env.get(name) or "").strip()

    def wrong(message: str) -> ProviderError:
        return ProviderError("configuration_error", message)

    numbers = {}
    for name, (default, least, most) in profile.numbers.items():
        key, text = f"{prefix}_{name.upper()}", given(f"{prefix}_{name.upper()}")
        try:
            value = float(text) if text else default
        except ValueError:
            value = math.nan
        if not math.isfinite(value) or value != int(value) or value < least or (most is not None and value > most):
            raise wrong(f"{key} must be a whole number from {least}" + (f" to {most}." if most is not None else "."))
        numbers[name] = int(value)
    made = Settings(given(f"{prefix}_ENABLED") == "true", given(f"{prefix}_API_KEY") or given(shared_key) or None, given(f"{prefix}_MODEL") or profile.model, given(f"{prefix}_BASE_URL") or profile.base_url, numbers)
    if profile.model and made.model != profile.model:
        raise wrong(f"{prefix}_MODEL must be {profile.model}.")
    for name, value in profile.fixed.items():
        if numbers[name] != value:
            raise wrong(f"{prefix}_{name.upper()} must be {value}.")
    if numbers.get("result_limit", 0) > numbers.get("candidate_limit", math.inf):
        raise wrong(f"{prefix}_RESULT_LIMIT must not be larger than {prefix}_CANDIDATE_LIMIT.")
    for what, value in (("API_KEY", made.api_key), ("MODEL", made.model)):
        if made.enabled and not value:
            raise wrong(f"{prefix}_{what} is needed where {prefix}_ENABLED is true.")
    return made


def _invalid(message: str) -> ProviderError:
    return ProviderError("validation_error", message)


def vector_of(value, dimensions: int) -> list[float]:
    """The vector, if it has the right length and only finite numbers."""
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)
    if not isinstance(value, (list, tuple)) or len(value) != dimensions or not all(map(number, value)):
        raise _invalid("Embedding vector is invalid.")
    return [float(x) for x in value]


def embedding_reply(value, model: str, dimensions: int) -> list[list[float]]:
    """The vectors of a reply {model, data: [{index, embedding}]} in the order of their indexes."""
    if not isinstance(value, dict) or not isinstance(value.get("data"), list) or value.get("model") != model:
        raise _invalid("An embedding reply has a data array and the model that was asked.")
    if not all(isinstance(item, dict) for item in value["data"]):
        raise _invalid("Each item of an embedding reply is an object.")
    place = lambda item, at: item["index"] if isinstance(item.get("index"), (int, float)) else at
    rows = [(place(item, at), vector_of(item.get("embedding"), dimensions)) for at, item in enumerate(value["data"])]
    return [v for _, v in sorted(rows, key=lambda r: r[0])]


def ranking_reply(value, n: int) -> list[tuple[int, float]]:
    """(index, logit) of a reply {rankings: [{index, logit}]} over n candidates: known indexes, each once, finite logits."""
    if not isinstance(value, dict) or not isinstance(value.get("rankings"), list) or not all(isinstance(x, dict) for x in value["rankings"]):
        raise _invalid("A ranking reply has an array of objects.")
    pairs = [(x.get("index"), x.get("logit")) for x in value["rankings"]]
    whole = lambda i: isinstance(i, int) and not isinstance(i, bool) and 0 <= i < n
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)
    if not all(whole(i) and number(x) for i, x in pairs) or len({i for i, _ in pairs}) < len(pairs):
        raise _invalid("A ranking reply names each candidate once, with a finite logit.")
    return [(i, float(x)) for i, x in pairs]
