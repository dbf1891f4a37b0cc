"""SQL text that several twins share: Spark's 64-bit hash and monotone fits, written out for DuckDB."""

from __future__ import annotations

_ALL = 1 << 64
# The five primes of the public xxHash64 definition.
_P1, _P2, _P3, _P4, _P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261


def _n(x: int) -> str:
    return f"CAST('{x}' AS UHUGEINT)"


def _times(x: str, p: int) -> str:
    return f"(({x}) * {_n(p)} % {_n(_ALL)})"


def _turned(x: str, r: int) -> str:
    return f"({x} * {_n(1 << r)} % {_n(_ALL)} + {x} // {_n(1 << (64 - r))})"


def _plus(x: str, c: int) -> str:
    return f"(({x} + {_n(c)}) % {_n(_ALL)})"


_LAST = [_times(f"xor(h, h // {_n(1 << 33)})", _P2), _times(f"xor(h, h // {_n(1 << 29)})", _P3), f"xor(h, h // {_n(1 << 32)})"]


def hash_sql(name: str, src: str, key: str, seed: int, text: bool = False) -> str:
    """CTE `name` (key, h): xxhash64(key, seed) of src's keys, unsigned. Keys are whole numbers from 0, or texts of five ASCII characters."""
    chars = [f"ascii(substr(k, {i + 1}, 1))" for i in range(5)]
    if text:
        word = " + ".join(f"{c} * {1 << (8 * i)}" for i, c in enumerate(chars[:4]))
        steps = [f"xor({_n((42 + _P5 + 5) % _ALL)}, {_times(f'CAST({word} AS UHUGEINT)', _P1)})", _plus(_times(_turned("h", 23), _P2), _P3)]
        steps += [f"xor(h, {_times(f'CAST({chars[4]} AS UHUGEINT)', _P5)})", _times(_turned("h", 11), _P1)]
    else:
        steps = [_times("CAST(k AS UHUGEINT)", _P2), f"xor({_n((42 + _P5 + 8) % _ALL)}, {_times(_turned('h', 31), _P1)})", _plus(_times(_turned("h", 27), _P1), _P4)]
    # The seed is hashed behind the key, as a 32-bit number.
    steps += [*_LAST, f"xor({_plus('h', (_P5 + 4) % _ALL)}, {_n(seed * _P1 % _ALL)})", _plus(_times(_turned("h", 23), _P2), _P3), *_LAST]
    out = f", {name}0 AS MATERIALIZED (SELECT k, {steps[0]} AS h FROM (SELECT DISTINCT {key} AS k FROM {src}))"
    for i, step in enumerate(steps[1:], 1):
        out += f", {name}{i} AS MATERIALIZED (SELECT k, {step} AS h FROM {name}{i - 1})"
    return f"{out}, {name} AS (SELECT k AS {key}, h FROM {name}{len(steps) - 1})"


def signed(h: str = "h") -> str:
    return f"CAST(CASE WHEN {h} >= {_n(1 << 63)} THEN CAST({h} AS HUGEINT) - CAST('{_ALL}' AS HUGEINT) ELSE CAST({h} AS HUGEINT) END AS BIGINT)"


def fold_sql(k: int, h: str = "h") -> str:
    return f"CAST((({signed(h)} % {k}) + {k}) % {k} AS INT)"


def uniform_sql(h: str = "h") -> str:
    return f"(CAST({h} % {_n(1 << 30)} AS DOUBLE) / {1 << 30})"


def monotone_sql(name: str, train: str, wanted: str, *keys: str) -> str:
    """CTE `name` (keys, x, g): monotone fits of train (keys, x, y, w) at the scores of wanted (keys, x).

    The fit at the i-th score is the largest over starts up to i of the smallest over ends from i of the mean between
    start and end; between scores it is linear, outside them it is the nearest one's.
    """
    k = "".join(f"{c}, " for c in keys)
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    same = lambda a, b: "".join(f"{a}.{c} = {b}.{c} AND " for c in keys)
    of = lambda a: "".join(f"{a}.{c}, " for c in keys)
    return f""", {name}_a AS (SELECT {k}x, CAST(sum(w * y) AS DOUBLE) AS s, CAST(sum(w) AS DOUBLE) AS w FROM {train} GROUP BY ALL),
{name}_b AS (SELECT {k}x, row_number() OVER ({part}ORDER BY x) AS i, sum(s) OVER ({part}ORDER BY x) AS cs, sum(w) OVER ({part}ORDER BY x) AS cw, sum(s) OVER ({part}ORDER BY x) - s AS ps, sum(w) OVER ({part}ORDER BY x) - w AS pw FROM {name}_a),
{name}_c AS (SELECT {of('l')}l.i AS j, h.i, (h.cs - l.ps) / (h.cw - l.pw) AS m FROM {name}_b l JOIN {name}_b h ON {same('l', 'h')}h.i >= l.i),
{name}_d AS (SELECT {k}i, min(m) OVER (PARTITION BY {k}j ORDER BY i DESC) AS m FROM {name}_c),
{name}_e AS (SELECT {k}i, max(m) AS g FROM {name}_d GROUP BY ALL),
{name}_f AS (SELECT {of('b')}b.x, g FROM {name}_b b JOIN {name}_e e ON {same('b', 'e')}b.i = e.i),
{name}_g AS (SELECT {of('v')}v.x, max(f.x) FILTER (f.x <= v.x) AS xl, min(f.x) FILTER (f.x >= v.x) AS xh, arg_max(g, f.x) FILTER (f.x <= v.x) AS gl, arg_min(g, f.x) FILTER (f.x >= v.x) AS gh FROM (SELECT DISTINCT {k}x FROM {wanted}) v JOIN {name}_f f ON {same('v', 'f')}true GROUP BY ALL),
{name} AS (SELECT {k}x, CASE WHEN xl IS NULL THEN gh WHEN xh IS NULL OR xl = xh THEN gl ELSE gl + (gh - gl) * (x - xl) / (xh - xl) END AS g FROM {name}_g)"""
