"""Kernel expressions as templates, rendered as Spark SQL for the engine and as DuckDB SQL for its checks.

A template is SQL in which ``//`` divides integers towards zero and these macros stand for what the dialects spell
differently: ``AT(list, i)`` element i from 0 (null outside), ``EACH(n, i, body)`` the list of body for i = 0 .. n-1,
``SUM(n, i, body)`` its sum, ``SHR(v, n)`` arithmetic shift, ``POW2(n)``, ``LIST(a, b, ...)``, ``FLOOR(v)`` as a long,
``PICK(body, name, value)`` body with the name bound to the value, ``CLIP(v, low, high)`` and ``SAMPLE(v, depth)``,
``PLANE(samples, w, h, x, y)`` the sample nearest to a place, ``MOD(a, n)`` never negative.
"""

from __future__ import annotations

import re

_MACRO = re.compile(r"\b([A-Z][A-Z0-9]+)\(")


def _arguments(text: str, at: int) -> tuple[list[str], int]:
    depth, parts, begin = 1, [], at
    for i in range(at, len(text)):
        if text[i] in "([":
            depth += 1
        elif text[i] in ")]":
            depth -= 1
            if not depth:
                return [*parts, text[begin:i].strip()], i + 1
        elif text[i] == "," and depth == 1:
            parts.append(text[begin:i].strip())
            begin = i + 1
    raise ValueError(f"unbalanced: {text[at - 20 : at + 60]}")


def _spark(name: str, a: list[str]) -> str | None:
    if name == "AT":
        return f"get({a[0]}, cast({a[1]} as int))"
    if name == "EACH":
        return f"transform(sequence(0L, cast({a[0]} as bigint) - 1L), {a[1]} -> {a[2]})"
    if name == "SUM":
        return f"aggregate(sequence(0L, cast({a[0]} as bigint) - 1L), 0L, (acc_{a[1]}, {a[1]}) -> acc_{a[1]} + cast({a[2]} as bigint))"
    if name == "SHR":
        return f"shiftright(cast({a[0]} as bigint), cast({a[1]} as int))"
    if name == "POW2":
        return f"shiftleft(1L, cast({a[0]} as int))"
    if name == "LIST":
        return f"array({', '.join(a)})"
    if name == "FLOOR":
        return f"cast(floor({a[0]}) as bigint)"
    if name == "MOD":
        return f"pmod({a[0]}, {a[1]})"
    if name == "PICK":
        return f"element_at(transform(array({a[2]}), {a[1]} -> {a[0]}), 1)"
    return None


def _duck(name: str, a: list[str]) -> str | None:
    if name == "AT":
        return f"(CASE WHEN ({a[1]}) >= 0 THEN ({a[0]})[({a[1]}) + 1] END)"
    if name == "EACH":
        return f"list_transform(range(CAST({a[0]} AS BIGINT)), lambda {a[1]}: {a[2]})"
    if name == "SUM":
        return f"CAST(list_sum(list_transform(range(CAST({a[0]} AS BIGINT)), lambda {a[1]}: {a[2]})) AS BIGINT)"
    if name == "SHR":
        return f"(CAST({a[0]} AS BIGINT) >> CAST({a[1]} AS BIGINT))"
    if name == "POW2":
        return f"(CAST(1 AS BIGINT) << CAST({a[0]} AS BIGINT))"
    if name == "LIST":
        return f"[{', '.join(a)}]"
    if name == "FLOOR":
        return f"CAST(floor({a[0]}) AS BIGINT)"
    if name == "MOD":
        return f"((({a[0]}) % ({a[1]}) + ({a[1]})) % ({a[1]}))"
    if name == "PICK":
        return f"(list_transform([{a[2]}], lambda {a[1]}: {a[0]}))[1]"
    return None


def _both(name: str, a: list[str]) -> str | None:
    if name == "CLIP":
        return f"greatest({a[1]}, least({a[0]}, {a[2]}))"
    if name == "SAMPLE":
        return f"greatest(0, least({a[0]}, POW2({a[1]}) - 1))"
    if name == "PLANE":
        return f"AT({a[0]}, greatest(0, least(({a[2]}) - 1, {a[4]})) * ({a[1]}) + greatest(0, least(({a[1]}) - 1, {a[3]})))"
    return None


def _render(text: str, dialect) -> str:
    out, at = [], 0
    while m := _MACRO.search(text, at):
        args, end = _arguments(text, m.end())
        args = [_render(x, dialect) for x in args]
        got = _both(m[1], args)
        got = _render(got, dialect) if got is not None else dialect(m[1], args)
        out.append(text[at : m.start()])
        out.append(got if got is not None else f"{m[1]}({', '.join(args)})")
        at = end
    return "".join([*out, text[at:]])


def spark_sql(template: str) -> str:
    return _render(template, _spark).replace("//", " div ")


def duck_sql(template: str) -> str:
    return _render(template, _duck)
