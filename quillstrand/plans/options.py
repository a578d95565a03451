"""Options of the array codec, from keywords or from text."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields
from enum import Enum


class Mode(Enum):
    ABS = "abs"
    REL = "rel"


class Predictor(Enum):
    LORENZO = "lorenzo"
    ZIGZAG = "lorenzo-zigzag"
    PROTO = "lorenzo-proto"
    SPLINE = "spline"


class Hist(Enum):
    GENERIC = "generic"
    SPARSE = "sparse"  # another plan in native engines; the same group-by here


class Codec(Enum):
    HUFFMAN = "huffman"
    BITSHUFFLE = "bitshuffle"
    PLAIN = "plain"  # codes as they are, a row each


@dataclass(frozen=True)
class Options:
    mode: Mode = Mode.REL
    eb: float = 0.1
    predictor: Predictor = Predictor.LORENZO
    hist: Hist = Hist.GENERIC
    codec: Codec = Codec.HUFFMAN
    radius: int = 512
    shape: tuple[int, int, int] | None = None
    codebook: object = None  # a Book that is used instead of one made from the data
    dump: tuple[str, ...] = ()  # "hist" and "quant": what else is written next to the archive

    @property
    def bins(self) -> int:
        return 2 * self.radius


def number(text: str) -> float:
    """A number with nothing after it."""
    value = float(text)
    return int(value) if re.fullmatch(r"[+-]?\d+", text.strip()) else value


def switch(text: str) -> bool:
    if text.lower() in ("on", "true", "yes", "1"):
        return True
    if text.lower() in ("off", "false", "no", "0"):
        return False
    raise ValueError(f"neither on nor off: {text}")


def pairs(text: str) -> dict[str, str]:
    """k=v,k=v"""
    out = {}
    for part in filter(None, text.split(",")):
        key, eq, value = part.partition("=")
        if not eq:
            raise ValueError(f"no value for {part}")
        out[key.strip()] = value.strip()
    return out


def shape(text: str, slowest_first: bool = False) -> tuple[int, int, int]:
    """Sides as 3600x1800, with x, *, -, comma or m between them; slowest_first takes them as z, y, x."""
    sides = [int(x) for x in re.split(r"[x*\-,m]", text)]
    if not 1 <= len(sides) <= 3 or min(sides) < 1:
        raise ValueError(f"no shape: {text}")
    if slowest_first:
        sides.reverse()
    return tuple(sides + [1] * (3 - len(sides)))


def dumps(text: str) -> tuple[str, ...]:
    """What to dump, with + between: hist, quant or all."""
    names = ("hist", "quant") if text == "all" else tuple(filter(None, text.split("+")))
    if set(names) - {"hist", "quant"}:
        raise ValueError(f"nothing to dump: {text}")
    return names


def parse(text: str) -> Options:
    """Options from k=v pairs: mode, eb, predictor, hist, codec, radius, shape, dump."""
    kinds = {"mode": Mode, "predictor": Predictor, "hist": Hist, "codec": Codec, "eb": number, "radius": int, "shape": shape, "dump": dumps}
    got = pairs(text)
    unknown = set(got) - set(kinds)
    if unknown:
        raise ValueError(f"unknown options: {', '.join(sorted(unknown))}; there are {', '.join(f.name for f in fields(Options))}")
    return Options(**{k: kinds[k](v) for k, v in got.items()})
