"""Kind and lane of an input, by the rules of each source's layout, and content prints."""

from __future__ import annotations

import json
import math
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Content kinds that are context, and origins that are automated.
CONTEXT_ITEMS = ("plugins.recommendations", "agents_md.instructions", "environments.environment_context", "skills.selected_skill_instructions")
AUTOMATED = ("peer", "coordinator", "auto-continuation")


def _no(x: Column) -> Column:
    return ~F.coalesce(x, F.lit(False))


def envelope(items: Column) -> Column:
    """Of a record's content kinds (array<string>; null entries: not text): any user text submits, known context alone is context."""
    context = F.forall(items, lambda x: F.coalesce(x.isin(*CONTEXT_ITEMS), F.lit(False)))
    return F.when(F.array_contains(items, "user.text"), "submission").when((F.size(items) > 0) & context, "context").otherwise("unknown")


def flat(tool_result: Column, blocks: Column, text: Column, origin: Column, interrupted: Column, scheduled: Column, meta: Column) -> Column:
    """Of a flat record: tool results and notices are context; then interruptions, schedules, origins, meta marks, and plain text.

    ``blocks``: types of the content's blocks (null: none; a null entry: untyped); ``text``: content that is a plain string.
    """
    tools = (F.size(blocks) > 0) & F.forall(blocks, lambda b: F.coalesce(b.isin("tool_result", "tool_use"), F.lit(False)))
    plain = F.forall(blocks, lambda b: F.coalesce(b.isin("text", "image"), F.lit(False)))
    yes = lambda x: F.coalesce(x, F.lit(False))
    return (
        F.when(yes(tool_result) | yes(tools) | yes(origin == "task-notification") | interrupted.isNotNull(), "context")
        .when(yes(scheduled) | yes(origin == "human") | yes(origin.isin(*AUTOMATED)), "submission")
        .when(yes(meta), "context").when(text.isNotNull(), F.when(text != "", "submission").otherwise("context"))
        .when(F.size(blocks) == 0, "context").when(yes(plain), "submission").otherwise("unknown")
    )


def headed(by_user: Column, plain: Column, missing_previous: Column, at_ms: Column, header_ms: Column) -> Column:
    """Of a message in a headed file: plain text by the user submits; where earlier files are missing what is older than the header replays."""
    replay = F.when(F.coalesce(at_ms < header_ms, F.lit(False)), "replay").otherwise("unknown")
    return F.when(missing_previous, replay).when(F.coalesce(by_user & plain, F.lit(False)), "submission").otherwise("unknown")


def platform(role: Column, observed: Column, display: Column, summary: Column, routable: Column) -> Column:
    """Of a platform message: what was only observed is context; a routable one of the user's, neither summed up nor shown otherwise, submits."""
    user = role == "user"
    seen = F.coalesce(observed > 0, F.lit(False)) | F.coalesce(display == "async_delegation_complete", F.lit(False))
    sent = F.coalesce((observed == 0) & (summary == 0), F.lit(False)) & display.isNull() & F.coalesce(routable, F.lit(False))
    return F.when(F.coalesce(user, F.lit(False)) & seen, "context").when(F.coalesce(user, F.lit(False)) & sent, "submission").otherwise("unknown")


def stored(ordinary: Column, parts: Column, plain: Column) -> Column:
    """Of a stored message of the user's: an ordinary message all of whose parts are plain text submits; what else it is isn't known."""
    sent = F.coalesce(ordinary & (parts > 0) & plain, F.lit(False))
    return F.when(sent, "submission").otherwise("unknown")


def lane(parent: Column, sidechain: Column | None = None, other: str = "subagent") -> Column:
    """main without a parent (and no side chain), else ``other``: subagent, or unknown where a parent doesn't tell."""
    aside = parent.isNotNull() if sidechain is None else parent.isNotNull() | F.coalesce(sidechain, F.lit(False))
    return F.when(aside, other).otherwise("main")


def _number(x: float) -> str:
    """A number as JavaScript prints it: shortest digits, no fraction for whole numbers, exponents from 1e21 and below 1e-6."""
    if not math.isfinite(x):
        return "null"
    if x == 0:
        return "0"
    mantissa, _, exponent = f"{abs(Decimal(repr(x))):e}".partition("e")
    digits, point = mantissa.replace(".", "").rstrip("0"), int(exponent) + 1  # 0.digits times ten to the point
    sign, n = "-" if x < 0 else "", len(digits)
    if n <= point <= 21:
        return sign + digits + "0" * (point - n)
    if 0 < point <= 21:
        return f"{sign}{digits[:point]}.{digits[point:]}"
    if -6 < point <= 0:
        return f"{sign}0.{'0' * -point}{digits}"
    return f"{sign}{digits[0]}{'.' + digits[1:] if n > 1 else ''}e{point - 1:+d}"


def _stable(value: object, without: frozenset[str]) -> str:
    if isinstance(value, dict):
        by_units = sorted(value.items(), key=lambda kv: kv[0].encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_stable(v, without)}" for k, v in by_units if k not in without) + "}"
    if isinstance(value, list):
        return "[" + ",".join(_stable(v, without) for v in value) + "]"
    return _number(value) if isinstance(value, float) else json.dumps(value, ensure_ascii=False)


def _not_json(name: str):
    raise ValueError(name)


def content_print(text: Column, without: tuple[str, ...] = ()) -> Column:
    """SHA-256 of a JSON text's content: keys sorted, those of ``without`` left out at every depth; null for what is not JSON.

    Numbers are what a double holds, printed as JavaScript does, so ``1.0`` and ``1`` are one content. No built-in function
    sorts keys at every depth or prints numbers so; hence Python, in Arrow batches.
    """
    left = frozenset(without)

    @F.pandas_udf("string")
    def stable(x: pd.Series) -> pd.Series:
        def one(t):
            try:
                return None if t is None else _stable(json.loads(t, parse_int=float, parse_constant=_not_json), left)
            except (ValueError, RecursionError):
                return None

        return x.map(one)

    return F.sha2(stable(text), 256)
