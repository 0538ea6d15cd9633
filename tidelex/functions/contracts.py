"""What each tier must return: fields, bounds, the wire schema and the contract sent as prose."""

from __future__ import annotations

import hashlib
import textwrap
from dataclasses import dataclass

# Enumerations, bounds and lengths of the typed readings.
STANCES = ("supportive", "neutral", "adverse")
SHOCK_KINDS = ("macro_policy", "geopolitical", "sector_wide", "issuer_governance",
               "issuer_results", "issuer_capital", "none")
AMPLITUDE = (-1.6, 3.0)
UNIT_RANGE = (0.0, 1.0)
SIGNED_RANGE = (-1.0, 1.0)
NULLISH = ("", "none", "n/a", "na", "null", "nil", "-", "unknown", "inconnu", "non applicable")
CONTRACT_WIDTH = 92


@dataclass(frozen=True)
class Field:
    name: str
    kind: str                                   # number, boolean, string, choice or literal
    about: str
    bounds: tuple[float, float] | None = None
    choices: tuple = ()
    limit: int | None = None
    blank_if_nullish: bool = False


def _number(name, bounds, about):
    return Field(name, "number", about, bounds=bounds)


_RELEVANCE = _number("relevance", UNIT_RANGE, "Bearing of the text on the risk of this issuer.")
_POLARITY = _number("polarity", SIGNED_RANGE, "Adverse (-1) to supportive (+1) for the issuer.")
_INTENSITY = _number("intensity", UNIT_RANGE, "Size of the implication, whatever its sign.")
_AMBIGUITY = _number("ambiguity", UNIT_RANGE, "How far the text allows opposed readings.")
_LEVEL = _number("log_amplitude", AMPLITUDE,
                 "Log of next-session volatility over its average of the last 22 sessions.")
_NEW = Field("is_new_information", "boolean", "Whether the text says something not yet public.")
_KIND = Field("shock_kind", "choice", "Where the text places the cause.", choices=SHOCK_KINDS)
_EVIDENCE = Field("evidence", "string", "A literal quotation that carries the reading, or empty.",
                  limit=240, blank_if_nullish=True)

TIERS: dict[str, tuple[Field, ...]] = {
    "analyst": (
        _RELEVANCE, _POLARITY, _INTENSITY, _AMBIGUITY,
        _number("forward_looking", UNIT_RANGE, "Share of the content about the future."),
        _NEW, _KIND,
        Field("stance", "choice", "Polarity in one word.", choices=STANCES), _EVIDENCE),
    "debate": (
        _number("polarity", SIGNED_RANGE, "Position on the next session's direction."),
        _number("conviction", UNIT_RANGE, "Share of the evidence that supports the position."),
        Field("strongest_point", "string", "The best element of the case.", limit=300),
        Field("concession", "string", "The best element against it.", limit=300)),
    "forecast": (
        _LEVEL, _number("lower", AMPLITUDE, "Lower end, at most log_amplitude."),
        _number("upper", AMPLITUDE, "Upper end, at least log_amplitude."),
        Field("driver", "string", "What in the documents drives the magnitude.", limit=300)),
    "single": (_RELEVANCE, _POLARITY, _INTENSITY, _AMBIGUITY, _LEVEL, _KIND, _NEW, _EVIDENCE),
    "verdict": (
        Field("direction", "choice", "Direction once weighed.", choices=STANCES), _LEVEL,
        Field("position", "literal", "Short, flat or long.", choices=(-1, 0, 1)),
        Field("rationale", "string", "Why, in two or three sentences.", limit=600)),
}
TIERS["panel"] = TIERS["forecast"]


def wire_schema(tier: str) -> dict:
    """JSON schema with nothing to resolve, every field required and no others allowed."""
    properties = {}
    for field in TIERS[tier]:
        node: dict = {"description": field.about}
        if field.kind == "number":
            node |= {"type": "number", "minimum": field.bounds[0], "maximum": field.bounds[1]}
        elif field.kind == "string":
            node |= {"type": "string", "maxLength": field.limit}
        elif field.kind == "boolean":
            node |= {"type": "boolean"}
        else:
            node |= {"enum": list(field.choices)}
        properties[field.name] = node
    return {"type": "object", "properties": properties, "required": list(properties),
            "additionalProperties": False}


def _shape(field: Field) -> str:
    if field.kind == "number":
        return f"number from {field.bounds[0]} to {field.bounds[1]}"
    if field.kind == "string":
        return f"text, at most {field.limit} characters"
    if field.kind == "boolean":
        return "true or false"
    return "one of " + " | ".join(str(c) for c in field.choices)


def contract(tier: str) -> str:
    """The shape as prose; the same tier always gives the same bytes."""
    lines = ["OUTPUT FORMAT", "Return one JSON object and nothing else, with exactly these keys:"]
    for field in TIERS[tier]:
        lines.append(f'  "{field.name}": {_shape(field)}')
        lines += textwrap.wrap(field.about, CONTRACT_WIDTH, initial_indent="      ",
                               subsequent_indent="      ", break_long_words=False,
                               break_on_hyphens=False)
    lines.append("Every key is required; other keys are ignored.")
    return "\n".join(lines)


def contract_sha(tier: str) -> str:
    return hashlib.sha256(contract(tier).encode()).hexdigest()


def system_prompt(mandate_text: str, tier: str) -> str:
    return f"{mandate_text}\n\n{contract(tier)}"
