"""Run configuration: defaults, overlays and field validation.  Driver-side values, no data."""

from __future__ import annotations

import copy
import datetime as dt
import hashlib
import json
import os
import re
from collections.abc import Mapping
from typing import Any

ENV_PREFIX, ENV_JOIN = "TALLYWEAVE_", "__"

# Every parameter a run may set, and the parameter sets that differ from the defaults.
DEFAULTS: dict[str, dict[str, Any]] = {
    "document": {"source": "", "summary_pages": [5, 7], "footnote_no": 11, "company": "", "period_end": "", "currency": "TL"},
    "ocr": {"dpi": 300, "psm": 4, "lang": "tur", "percent_rescue": True},
    "candidates": {"rrf_k": 10.0, "anchor_weight": 3.0, "top_k": 8, "dense_model": "", "dense_model_revision": ""},
    "linking": {"cross_encoder_model": "", "cross_encoder_revision": "", "accept_threshold": 0.5, "rank1_min_score": 0.2, "lexical_threshold": 0.75, "llm": {"enabled": False, "base_url": "", "model": "", "cache_path": ""}},
    "confidence": {"low_confidence_flag": 0.5, "second_engine": True, "extra_control_pages": []},
    "output": {"dir": "", "emit_report_html": True},
}

SCENARIOS: dict[str, dict[str, Any]] = {
    "baseline": {},
    "strict-linker": {"linking": {"accept_threshold": 0.8}},
    "lenient-linker": {"linking": {"accept_threshold": 0.2}},
    "no-percent-rescue": {"ocr": {"percent_rescue": False}},
    "psm-6": {"ocr": {"psm": 6}},
    "dense-swap": {"candidates": {"dense_model": "sentence-transformers/paraphrase-multilingual-MiniLM-L12-v2", "dense_model_revision": "e8f8c211226b894fcb81acc59f3b34ba3efd5f42"}},
    "reranker-tr-modernbert": {"linking": {"cross_encoder_model": "ytu-ce-cosmos/modernbert-tr-reranker", "cross_encoder_revision": "d6aabbe061f1bf6cb796e317ecb6d9b8f7b96c54"}},
    "lenient-lexical": {"linking": {"lexical_threshold": 0.4}},
    "footnote-10": {"document": {"footnote_no": 10}},
    "footnote-12": {"document": {"footnote_no": 12}},
    "footnote-13": {"document": {"footnote_no": 13}},
    "dpi-400": {"ocr": {"dpi": 400}},
    "narrow-candidates": {"candidates": {"top_k": 2}},
    "rrf-k60": {"candidates": {"rrf_k": 60}},
    "no-second-engine": {"confidence": {"second_engine": False}},
    "no-anchor-channel": {"candidates": {"anchor_weight": 0.0}},
    "fallback-calibration": {"confidence": {"extra_control_pages": []}},
    "llm-tier": {"linking": {"llm": {"enabled": True}}},
}


def overlay(base: Mapping[str, Any], change: Mapping[str, Any]) -> dict[str, Any]:
    """``base`` with ``change`` laid over it; mappings merge, anything else replaces.  Inputs stay as they are."""
    out = copy.deepcopy(dict(base))
    for k, v in change.items():
        out[k] = overlay(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else copy.deepcopy(v)
    return out


def _from_env(env: Mapping[str, str]) -> dict[str, Any]:
    out: dict[str, Any] = {}
    for name, raw in env.items():
        if name.startswith(ENV_PREFIX):
            at = out
            *path, leaf = name.removeprefix(ENV_PREFIX).lower().split(ENV_JOIN)
            for p in path:
                at = at.setdefault(p, {})
            try:
                at[leaf] = json.loads(raw)
            except ValueError:
                at[leaf] = raw
    return out


def settings(given: Mapping[str, Any] | None = None, file: Mapping[str, Any] | None = None, env: Mapping[str, str] | None = None) -> dict[str, Any]:
    """Arguments before environment before file before defaults."""
    out = DEFAULTS
    for layer in (file or {}, _from_env(os.environ if env is None else env), given or {}):
        out = overlay(out, layer)
    return out


def scenario(name: str) -> dict[str, Any]:
    return settings(SCENARIOS[name], env={})


def config_id(data: bytes, config: Mapping[str, Any], known: Mapping[str, str] | None = None) -> str:
    """Id of an upload: a prefix of its hash; a second configuration of the same bytes gets a suffix."""
    base = hashlib.sha256(data).hexdigest()[:12]
    tag = hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:6]
    return base if (known or {}).get(base, tag) == tag else f"{base}-{tag}"


# Fixed patterns of upload fields: letters, digits and underscores (one letter or digit at least); a language
# code may also have a plus or a hyphen.
CURRENCY, LANGUAGE = r"(?=.*[^\W_])\w{1,8}", r"[\w+-]{1,24}"


class FieldError(ValueError):
    pass


def upload_fields(raw: Mapping[str, Any]) -> dict[str, Any]:
    """Trimmed and checked upload fields: ISO date, currency, language, page bounds, distinct pages, no overlap.

    ``page_count``, where given, leaves at least one page behind the summary pages and bounds the control pages.
    """
    text = lambda k: str(raw.get(k) or "").strip()
    out: dict[str, Any] = {"company": text("company"), "currency": text("currency").upper() or "TL", "lang": text("lang").lower() or "tur"}
    if not out["company"]:
        raise FieldError("company is empty")
    try:
        out["period_end"] = dt.date.fromisoformat(text("period_end")).isoformat() if text("period_end") else ""
    except ValueError as e:
        raise FieldError("period_end is no ISO date") from e
    if not re.fullmatch(CURRENCY, out["currency"]):
        raise FieldError("currency must be a short code")
    if not re.fullmatch(LANGUAGE, out["lang"]):
        raise FieldError("lang must be a language code")
    first, last = (int(x) for x in raw.get("summary_pages") or (1, 1))
    pages = int(raw.get("page_count") or 999)
    if not 1 <= first <= last <= pages:
        raise FieldError("summary pages must rise from 1 and lie within the document")
    if last == raw.get("page_count"):
        raise FieldError("summary pages must leave a later page")
    controls = list(dict.fromkeys(int(p) for p in raw.get("control_pages") or ()))
    if any(not 1 <= p <= pages for p in controls):
        raise FieldError("control pages out of bounds")
    if any(first <= p <= last for p in controls):
        raise FieldError("control pages overlap the summary pages")
    if not 1 <= int(raw.get("footnote_no") or 1) <= 99:
        raise FieldError("footnote number out of bounds")
    return out | {"summary_pages": [first, last], "control_pages": controls, "footnote_no": int(raw.get("footnote_no") or 1)}
