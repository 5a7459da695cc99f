"""Entropy readers: the arithmetic decoder with the binarizations on top of it, and a scripted one for tests.

The tables of the arithmetic model (ranges of the less probable symbol by state and quarter of the range, the states
after it) and the initial values of the contexts are data of the coded format; they are given to the decoder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from .bits import BitReader, BitstreamError


def _invalid(message: str) -> BitstreamError:
    return BitstreamError("invalid syntax value", message)


class Context:
    """The state of one adaptive bin."""

    def __init__(self, state: int, mps: int) -> None:
        self.state, self.mps = min(state, 63), mps & 1

    @classmethod
    def initial(cls, value: int, qp: int) -> Context:
        """From an initial value and the slice's quantiser."""
        before = ((value >> 4) * 5 - 45) * max(0, min(51, qp)) >> 4
        before = max(1, min(126, before + (value & 15) * 8 - 16))
        return cls(63 - before, 0) if before <= 63 else cls(before - 64, 1)


class Entropy:
    """What slice data is read with. The base methods build every binarization from three kinds of bins."""

    def bin(self, name: str, inc: int) -> int:
        """A bin with the context ``inc`` of a syntax element."""
        raise NotImplementedError

    def bypass(self) -> int:
        raise NotImplementedError

    def terminate(self) -> int:
        raise NotImplementedError

    def flag(self, name: str, inc: int = 0) -> bool:
        return bool(self.bin(name, inc))

    def bits(self, n: int) -> int:
        value = 0
        for _ in range(n):
            value = value << 1 | self.bypass()
        return value

    def ones(self, most: int, more: Callable[[int], int]) -> int:
        """How many ones come before a zero, ``most`` at most; ``more(k)`` reads bin k."""
        n = 0
        while n < most and more(n):
            n += 1
        return n

    def rice(self, c_max: int, rice: int = 0, more: Callable[[int], int] | None = None) -> int:
        """Truncated Rice; the prefix in bypass bins unless ``more`` reads it."""
        whole = c_max >> rice
        prefix = self.ones(whole, more or (lambda _: self.bypass()))
        if prefix == whole:
            return c_max
        value = prefix << rice | self.bits(rice)
        if value > c_max:
            raise _invalid("value exceeds its maximum")
        return value

    def rice_in(self, name: str, inc: int, n_contexts: int, c_max: int, same: bool = False) -> int:
        """Truncated unary whose first bins have contexts, ascending or the same one."""
        return self.rice(c_max, 0, lambda k: self.bin(name, inc if same else inc + k) if k < n_contexts else self.bypass())

    def fixed(self, c_max: int) -> int:
        value = self.bits(c_max.bit_length())
        if value > c_max:
            raise _invalid("value exceeds its maximum")
        return value

    def truncated(self, c_max: int) -> int:
        k = (c_max + 1).bit_length() - 1
        short = (2 << k) - c_max - 1
        value = self.bits(k)
        return value if value < short else (value << 1 | self.bypass()) - short

    def golomb(self, order: int) -> int:
        value = 0
        while self.bypass():
            value += 1 << order
            order += 1
            if order > 63:
                raise BitstreamError("exp-golomb overflow")
        return value + self.bits(order)

    def limited_golomb(self, rice: int, log2_range: int) -> int:
        if rice >= 32 or not 1 <= log2_range <= 28:
            raise _invalid("parameters are out of range")
        most = 28 - log2_range
        prefix = self.ones(most, lambda _: self.bypass())
        value = (((1 << prefix) - 1) << rice) + self.bits(log2_range if prefix == most else prefix + rice)
        if prefix < most and value >> rice > (2 << prefix) - 2:
            raise _invalid("prefix and suffix are inconsistent")
        return value

    def part_mode(self, intra: bool, smallest: bool, asymmetric: bool) -> int:
        if self.bin("part_mode", 0):
            return 0
        if intra:
            return 1
        across = 1 if self.bin("part_mode", 1) else 2  # halves above each other, or beside each other
        if smallest:
            return across
        if across == 2 and self.bin("part_mode", 2):
            return 2
        if not asymmetric:
            return 1 if across == 1 else 3
        if self.bypass():
            return 1 if across == 1 else 3
        return (4 if across == 1 else 6) + self.bypass()

    def direction(self, width: int, height: int, depth: int) -> int:
        """Which lists an inter block uses: the first, the second or both (2)."""
        small = width + height == 12
        if self.bin("inter_pred_idc", 4 if small else depth):
            return 2
        return 0 if small else self.bin("inter_pred_idc", 4)

    def qp_delta(self) -> int:
        prefix = self.ones(5, lambda k: self.bin("cu_qp_delta_abs", min(k, 1)))
        if prefix < 5:
            return prefix
        n = self.ones(7, lambda _: self.bypass())
        if n == 7:
            raise _invalid("delta suffix is too long")
        return 5 + (((1 << n) - 1) | self.bits(n))  # put over the sum, not added to it

    def remaining(self, rice: int, extended: bool, log2_range: int) -> int:
        """What a coefficient's level has beyond its flags."""
        if rice >= 32:
            raise _invalid("rice parameter is too large")
        prefix = self.ones(31, lambda _: self.bypass())
        if prefix == 31:
            raise _invalid("prefix is too long")
        if prefix < 3:
            return (prefix << rice) + self.bits(rice)
        rest = self.limited_golomb(rice + prefix - 3, log2_range) if extended else self.bits(prefix - 3 + rice)
        return (((1 << prefix - 3) + 2) << rice) + rest

    def palette_value(self, depth: int, lossless: bool) -> int:
        return self.fixed((1 << depth) - 1) if lossless else self.golomb(3)

    def palette_count(self, largest: int) -> int:
        rice = 3 + (largest + 1 >> 3)
        c_max = 4 << rice
        value = self.rice(c_max, rice)
        return value + self.golomb(rice + 1) if value == c_max else value

    def palette_index(self, largest: int) -> int:
        return self.truncated(largest)

    def run_prefix(self, most: int, index: int, above: bool) -> int:
        later = [5, 6, 6, 7, 7] if above else [0 if index < 1 else 1 if index < 3 else 2, 3, 3, 4, 4]
        return self.ones(most.bit_length(), lambda k: self.bin("palette_run_prefix", later[k]) if k < 5 else self.bypass())

    def run_suffix(self, most: int, prefix: int) -> int:
        base = 1 << prefix - 1
        return self.truncated(most - base if 2 * base > most else base - 1)

    # what only a coded stream has: alignment, substreams, saved contexts
    def align(self) -> None: ...

    def align_bypass(self) -> None: ...

    def substream(self, start: int, end: int) -> None: ...

    def restart(self) -> None: ...

    def reset(self) -> None: ...

    def store(self) -> None: ...

    def synchronize(self) -> bool:
        return False


class Scripted(Entropy):
    """Takes every value, however it would be coded, from a list."""

    def __init__(self, values: Iterable[int]) -> None:
        self.values = list(values)[::-1]

    def next(self, *_: object) -> int:
        if not self.values:
            raise BitstreamError("unexpected end", "1 bits wanted, 0 left")
        return self.values.pop()

    bin = bypass = terminate = rice = fixed = truncated = golomb = limited_golomb = part_mode = direction = next
    qp_delta = remaining = palette_value = palette_count = palette_index = run_prefix = run_suffix = next

    def rice_in(self, *_: object, **__: object) -> int:
        return self.next()


class Arithmetic(Entropy):
    """The arithmetic decoder. ``initial`` has the initial values of the contexts of each syntax element."""

    def __init__(self, reader: BitReader, lps_ranges: list[list[int]], after_lps: list[int], initial: dict[str, list[int]] | None = None, qp: int = 26) -> None:
        self.reader, self.lps_ranges, self.after_lps = reader, lps_ranges, after_lps
        self.first = {n: [Context.initial(v, qp) for v in values] for n, values in (initial or {}).items()}
        self.stored: dict[str, list[Context]] | None = None
        self.contexts = _copy(self.first)
        self.ended = False
        self.restart()

    def restart(self) -> None:
        self.range, self.offset, self.ended = 510, self.reader.u(9), False
        if self.offset >= 510:
            raise _invalid("arithmetic offset must not be 510 or 511")

    def _grow(self) -> None:
        while self.range < 256:
            self.range, self.offset = self.range << 1, self.offset << 1 | self.reader.u(1)
        if self.offset >= self.range:
            raise _invalid("arithmetic offset is outside the interval")

    def decision(self, context: Context) -> int:
        lps = self.lps_ranges[context.state][self.range >> 6 & 3]
        self.range -= lps
        if self.offset < self.range:
            value = context.mps
            if context.state < 62:
                context.state += 1
        else:
            value, self.offset, self.range = 1 - context.mps, self.offset - self.range, lps
            if context.state == 0:
                context.mps = 1 - context.mps
            context.state = self.after_lps[context.state]
        self._grow()
        return value

    def bin(self, name: str, inc: int) -> int:
        contexts = self.contexts.get(name, ())
        if inc >= len(contexts):
            raise _invalid(f"no context {inc} of {name}")
        return self.decision(contexts[inc])

    def bypass(self) -> int:
        self.offset = self.offset << 1 | self.reader.u(1)
        if self.offset < self.range:
            return 0
        self.offset -= self.range
        return 1

    def terminate(self) -> int:
        self.range -= 2
        if self.offset >= self.range:
            self.ended = True
            return 1
        self._grow()
        return 0

    def align(self) -> None:
        if not self.ended and not self.reader.u(1):
            raise BitstreamError("invalid alignment bit")
        self._zeros()
        self.ended = False

    def _zeros(self) -> None:
        while not self.reader.aligned():
            if self.reader.u(1):
                raise BitstreamError("invalid alignment zero")

    def align_bypass(self) -> None:
        self.range = 256

    def substream(self, start: int, end: int) -> None:
        self.reader = self.reader.part(start, end - start)

    def reset(self) -> None:
        self.contexts, self.stored = _copy(self.first), None

    def store(self) -> None:
        self.stored = _copy(self.contexts)

    def synchronize(self) -> bool:
        if self.stored is None:
            return False
        self.contexts = _copy(self.stored)
        return True

    def pcm(self, n_luma: int, n_chroma: int, luma_bits: int, chroma_bits: int) -> tuple[list[int], list[int]]:
        """Samples as they are, from the next byte on; the arithmetic decoder starts anew behind them."""
        self._zeros()
        samples = [self.reader.u(luma_bits) for _ in range(n_luma)], [self.reader.u(chroma_bits) for _ in range(n_chroma)]
        self.restart()
        return samples

    def trailing(self) -> int:
        """The closing of a slice; the zero words behind it."""
        if not self.ended and not self.terminate():
            raise BitstreamError("invalid alignment bit")
        self._zeros()
        n = 0
        while self.reader.left >= 16:
            if self.reader.u(16):
                raise _invalid("cabac_zero_word must equal 0x0000")
            n += 1
        if self.reader.left:
            raise _invalid("trailing data isn't a whole number of words")
        return n


def _copy(contexts: dict[str, list[Context]]) -> dict[str, list[Context]]:
    return {n: [Context(c.state, c.mps) for c in cs] for n, cs in contexts.items()}
