"""The scalar function table shared by ``math`` and ``field-math``."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def rounded(x: Column) -> Column:
    """Half away from zero, as a double."""
    return F.round(x)


def to_byte(x: Column) -> Column:
    """A share of 1 as 0..255."""
    return F.least(F.greatest(F.round(x * 255), F.lit(0.0)), F.lit(255.0)).cast("int")


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    low, high = (v if isinstance(v, Column) else F.lit(float(v)) for v in (low, high))
    return F.least(F.greatest(x, low), high)


def _guarded(ok: Column, value: Column) -> Column:
    return F.when(ok, value)


def _smoothstep(a: Column, b: Column, x: Column) -> Column:
    t = clamp(F.try_divide(x - a, b - a), 0, 1)
    return F.when(a == b, F.when(x < a, 0.0).otherwise(1.0)).otherwise(t * t * (3 - 2 * t))


#: name -> (number of operands, function). Results that are not finite come back as null or NaN; see ``apply``.
FUNCTIONS: dict[str, tuple[int, Callable[..., Column]]] = {
    "abs": (1, F.abs),
    "neg": (1, lambda a: -a),
    "floor": (1, lambda a: F.floor(a).cast("double")),
    "ceil": (1, lambda a: F.ceil(a).cast("double")),
    "round": (1, rounded),
    "fract": (1, lambda a: a - F.floor(a)),
    "sign": (1, F.signum),
    "sqrt": (1, lambda a: _guarded(a >= 0, F.sqrt(a))),
    "exp": (1, F.exp),
    "log": (1, lambda a: _guarded(a > 0, F.ln(a))),
    "log2": (1, lambda a: _guarded(a > 0, F.log2(a))),
    "log10": (1, lambda a: _guarded(a > 0, F.log10(a))),
    "sin": (1, F.sin),
    "cos": (1, F.cos),
    "tan": (1, F.tan),
    "asin": (1, lambda a: _guarded(F.abs(a) <= 1, F.asin(a))),
    "acos": (1, lambda a: _guarded(F.abs(a) <= 1, F.acos(a))),
    "atan": (1, F.atan),
    "atan2": (2, F.atan2),
    "step": (2, lambda edge, x: F.when(x < edge, 0.0).otherwise(1.0)),
    "smoothstep": (3, _smoothstep),
    "add": (2, lambda a, b: a + b),
    "sub": (2, lambda a, b: a - b),
    "mul": (2, lambda a, b: a * b),
    "div": (2, F.try_divide),
    "mod": (2, lambda a, b: F.when(b != 0, a - F.abs(b) * F.floor(a / F.abs(b)))),
    "min": (2, F.least),
    "max": (2, F.greatest),
    "pow": (2, F.pow),
    "clamp": (3, lambda a, b, c: F.greatest(F.least(a, F.greatest(b, c)), F.least(b, c))),
    "lerp": (3, lambda a, b, c: a + (b - a) * c),
}


def finite(x: Column) -> Column:
    """``x``, or null if it is not finite."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def apply(name: str, *operands: Column) -> Column:
    """A function of the table on doubles; a missing operand or a result that is not finite gives null."""
    arity, function = FUNCTIONS[name]
    if len(operands) != arity:
        raise ValueError(f"{name} takes {arity} operands, not {len(operands)}")
    operands = [o.cast("double") for o in operands]
    known = operands[0].isNotNull()
    for o in operands[1:]:
        known = known & o.isNotNull()
    return F.when(known, finite(function(*operands).cast("double")))


def fold(name: str, *operands: float) -> float:
    """The same on plain numbers, for scalars known when a plan is built; a result that is not finite is an error."""
    a, *rest = map(float, operands)
    if len(operands) != FUNCTIONS[name][0]:
        raise ValueError(f"{name} takes {FUNCTIONS[name][0]} operands, not {len(operands)}")
    b, c = (*rest, NAN, NAN)[:2]
    half_up = lambda v: math.floor(abs(v) + 0.5) * (1 if v >= 0 else -1)
    own = {
        "neg": lambda: -a, "abs": lambda: abs(a), "round": lambda: half_up(a), "fract": lambda: a - math.floor(a),
        "sign": lambda: float((a > 0) - (a < 0)), "log": lambda: math.log(a), "step": lambda: 0.0 if b < a else 1.0,
        "add": lambda: a + b, "sub": lambda: a - b, "mul": lambda: a * b, "div": lambda: a / b,
        "mod": lambda: a - abs(b) * math.floor(a / abs(b)), "min": lambda: min(a, b), "max": lambda: max(a, b),
        "clamp": lambda: max(min(a, max(b, c)), min(b, c)), "lerp": lambda: a + (b - a) * c,
        "smoothstep": lambda: (0.0 if c < a else 1.0) if a == b else (lambda t: t * t * (3 - 2 * t))(min(max((c - a) / (b - a), 0), 1)),
    }
    try:
        out = float(own[name]() if name in own else getattr(math, name)(*map(float, operands)))
    except (ValueError, ZeroDivisionError, OverflowError):
        out = NAN
    if not math.isfinite(out):
        raise ArithmeticError(f"{name}{tuple(operands)} is not finite")
    return out
