"""Content keys, prices and estimates of a call, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# USD per million tokens in and out, pessimistic characters per token, output cap.
PRICE_IN_PER_M = 0.30
PRICE_OUT_PER_M = 1.20
PESSIMISTIC_CHARS_PER_TOKEN = 3.0
MAX_OUTPUT_TOKENS = 900


def short(sha: Column, length: int = 16) -> Column:
    return F.substring(sha, 1, length)


def cache_key(model: str, mandate: Column, mandate_sha: Column, replicate: Column,
              temperature: float, context_sha: Column, contract_sha: Column | None = None) -> Column:
    """SHA-256 over everything that can change an answer, joined by `|`."""
    parts = [F.lit(model), mandate, mandate_sha, replicate.cast("string"),
             F.lit(f"{temperature:.4f}"), context_sha]
    if contract_sha is not None:
        parts.append(contract_sha)
    return F.sha2(F.concat_ws("|", *parts), 256)


def call_cost(tokens_in: Column, tokens_out: Column, price_in: float = PRICE_IN_PER_M,
              price_out: float = PRICE_OUT_PER_M) -> Column:
    return tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out


def cost_estimate(context_chars: Column, system_chars: Column,
                  max_output_tokens: int = MAX_OUTPUT_TOKENS) -> Column:
    """Upper estimate: three characters per token in, the whole output budget out."""
    return call_cost((context_chars + system_chars) / PESSIMISTIC_CHARS_PER_TOKEN,
                     F.lit(float(max_output_tokens)))


def token_estimate(context_chars: Column, system_chars: Column,
                   max_output_tokens: int = MAX_OUTPUT_TOKENS) -> Column:
    return (context_chars + system_chars) / PESSIMISTIC_CHARS_PER_TOKEN + max_output_tokens
