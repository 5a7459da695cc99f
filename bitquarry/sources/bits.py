"""Reading and writing of bit-serial data: fixed and Exp-Golomb codes, strings, alignment, escaping."""

from __future__ import annotations


class BitstreamError(ValueError):
    """A kind that rows can carry, and a message."""

    def __init__(self, kind: str, message: str = "") -> None:
        super().__init__(f"{kind}: {message}" if message else kind)
        self.kind = kind


class BitReader:
    """Bits of a byte string, most significant first, up to a limit."""

    def __init__(self, data: bytes, start: int = 0, end: int | None = None) -> None:
        self.data, self.at = data, start
        self.end = 8 * len(data) if end is None else end

    @property
    def left(self) -> int:
        return self.end - self.at

    def peek(self, n: int, beyond: bool = False) -> int:
        """The next n bits without taking them; ``beyond`` reads zeros behind the end."""
        if n > 64:
            raise BitstreamError("invalid syntax value", "at most 64 bits at a time")
        lack = n - self.left
        if lack > 0 and not beyond:
            raise BitstreamError("unexpected end", f"{n} bits wanted, {self.left} left")
        have = n - max(0, lack)
        first, last = self.at // 8, (self.at + have + 7) // 8
        value = int.from_bytes(self.data[first:last], "big") >> (8 * last - self.at - have) & ((1 << have) - 1)
        return value << (n - have)

    def u(self, n: int) -> int:
        if n == 1 and self.at < self.end:  # most of what arithmetic decoding and codes ask for
            at = self.at
            self.at = at + 1
            return self.data[at >> 3] >> (~at & 7) & 1
        value = self.peek(n)
        self.at += n
        return value

    def i(self, n: int) -> int:
        """Two's complement."""
        value = self.u(n)
        return value - (1 << n) if n and value >> (n - 1) else value

    def ue(self) -> int:
        # a code of a few bits lies in the next bytes as a whole; longer ones, and what is cut short, bit by bit
        at, have = self.at, min(self.end - self.at, 40)
        if have > 0:
            last = at + have + 7 >> 3
            word = int.from_bytes(self.data[at >> 3 : last], "big") >> 8 * last - at - have & (1 << have) - 1
            n = 2 * (have - word.bit_length()) + 1
            if n <= have:
                self.at = at + n
                return (word >> have - n) - 1
        zeros = 0
        while self.left and not self.peek(1):
            self.at += 1
            zeros += 1
            if zeros > 63:
                raise BitstreamError("exp-golomb overflow")
        self.u(1)
        return (1 << zeros) - 1 + self.u(zeros)

    def se(self) -> int:
        return signed_of_code(self.ue())

    def aligned(self) -> bool:
        return self.at % 8 == 0

    def b(self) -> int:
        if not self.aligned():
            raise BitstreamError("not byte aligned")
        return self.u(8)

    def st(self) -> str:
        """A string of UTF-8 up to a zero byte."""
        if not self.aligned():
            raise BitstreamError("not byte aligned")
        stop = self.data.find(b"\0", self.at // 8, self.end // 8)
        if stop < 0:
            raise BitstreamError("missing string terminator")
        raw, self.at = self.data[self.at // 8 : stop], 8 * (stop + 1)
        try:
            return raw.decode()
        except UnicodeDecodeError:
            raise BitstreamError("invalid utf-8") from None

    def more_data(self) -> bool:
        """Whether anything but the closing one and zeros follows."""
        return self.left > 0 and (self.peek(1) == 0 or any(self._bits(self.at + 1)))

    def _bits(self, start: int):
        while start < self.end:
            n = min(64, self.end - start)
            yield BitReader(self.data, start, self.end).peek(n)
            start += n

    def trailing(self) -> None:
        """A one, and zeros up to the next byte."""
        if not self.u(1):
            raise BitstreamError("invalid alignment bit")
        while not self.aligned():
            if self.u(1):
                raise BitstreamError("invalid alignment zero")

    def align(self) -> None:
        if not self.aligned():
            self.trailing()

    def read(self, descriptor: str) -> int | str:
        """A value by its descriptor: b, f(n), u(n), i(n), ue, se, st; ae is read by arithmetic decoding only."""
        name, _, n = descriptor.rstrip(")").partition("(")
        if name == "ae":
            raise BitstreamError("arithmetic coding unsupported")
        reader = {"f": self.u}.get(name) or getattr(self, name)
        return reader(int(n)) if n else reader()

    def part(self, offset: int, length: int) -> BitReader:
        """A reader of ``length`` bytes from a byte offset of all the data."""
        if length < 0 or offset + length > len(self.data):
            raise BitstreamError("unexpected end", "substream lies behind the data")
        return BitReader(self.data, 8 * offset, 8 * (offset + length))


class BitWriter:
    """The counterpart of BitReader."""

    def __init__(self) -> None:
        self.value = self.n = 0

    def u(self, n: int, value: int) -> BitWriter:
        self.value, self.n = self.value << n | value & ((1 << n) - 1), self.n + n
        return self

    def ue(self, value: int) -> BitWriter:
        width = (value + 1).bit_length()
        return self.u(2 * width - 1, value + 1)

    def se(self, value: int) -> BitWriter:
        return self.ue(code_of_signed(value))

    def trailing(self) -> BitWriter:
        self.u(1, 1)
        return self.u(-self.n % 8, 0)

    def bytes(self) -> bytes:
        return (self.value << (-self.n % 8)).to_bytes((self.n + 7) // 8, "big")


def signed_of_code(code: int) -> int:
    """0, 1, -1, 2, -2, ... in the order of the codes."""
    return (code + 1) // 2 if code % 2 else -(code // 2)


def code_of_signed(value: int) -> int:
    return 2 * value - 1 if value > 0 else -2 * value


def unescape(data: bytes) -> bytes:
    """Without the 3s that stand behind two zeros."""
    return b"".join(_unescaped(data))


def _unescaped(data: bytes):
    at = 0
    while (stop := data.find(b"\0\0\3", at)) >= 0:
        yield data[at : stop + 2]
        at = stop + 3
    yield data[at:]


def escape(data: bytes) -> bytes:
    """With a 3 before every byte up to 3 that stands behind two zeros."""
    out, zeros = bytearray(), 0
    for byte in data:
        if zeros >= 2 and byte <= 3:
            out.append(3)
            zeros = 0
        out.append(byte)
        zeros = zeros + 1 if byte == 0 else 0
    return bytes(out)


def dropped_before(escaped: bytes, offset: int) -> int:
    """How many bytes unescaping drops before an offset, which turns offsets of escaped data into plain ones."""
    return offset - len(unescape(escaped[:offset]))


# --- bin strings ---------------------------------------------------------------------------------------------


def _digits(value: int, n: int) -> str:
    return format(value, f"0{n}b") if n else ""


def _width(c_max: int) -> int:
    return c_max.bit_length()


def encode_bins(value: int, scheme: str, c_max: int = 0, rice: int = 0, order: int = 0, log2_range: int = 15) -> str:
    """The bins of a value as a string of 0 and 1; schemes FL, TB, TR, EG and LEG."""
    if scheme in ("FL", "TB", "TR") and value > c_max:
        raise BitstreamError("invalid syntax value", "value exceeds its maximum")
    if scheme == "FL":
        return _digits(value, _width(c_max))
    if scheme == "TB":
        k = (c_max + 1).bit_length() - 1
        short = (2 << k) - (c_max + 1)
        return _digits(value, k) if value < short else _digits(value + short, k + 1)
    if scheme == "TR":
        if rice >= 32:
            raise BitstreamError("invalid syntax value", "rice parameter is too large")
        whole = "1" * min(value >> rice, c_max >> rice)
        return whole if value >= c_max else whole + "0" + _digits(value & ((1 << rice) - 1), rice)
    if scheme == "EG":
        out = ""
        while value >= 1 << order:
            out, value, order = out + "1", value - (1 << order), order + 1
            if order > 31:
                raise BitstreamError("exp-golomb overflow")
        return out + "0" + _digits(value, order)
    if scheme == "LEG":
        if rice >= 32 or not 1 <= log2_range <= 28:
            raise BitstreamError("invalid syntax value", "parameters are out of range")
        most, prefix = 28 - log2_range, 0
        while prefix < most and value >> rice > (2 << prefix) - 2:
            prefix += 1
        rest = value - (((1 << prefix) - 1) << rice)
        width = log2_range if prefix == most else prefix + rice
        if rest < 0 or width < 32 and rest >> width:
            raise BitstreamError("invalid syntax value", "value doesn't fit its suffix")
        return "1" * prefix + ("" if prefix == most else "0") + _digits(rest & ((1 << width) - 1), width)
    raise BitstreamError("invalid syntax value", f"no scheme {scheme}")


def decode_bins(bins: str, scheme: str, c_max: int = 0, rice: int = 0, order: int = 0, log2_range: int = 15) -> int:
    """The value of a whole bin string; anything too short, too long or beyond the maximum is an error."""
    ones = len(bins) - len(bins.lstrip("1"))

    def number(text: str, n: int) -> int:
        if len(text) < n:
            raise BitstreamError("unexpected end", "1 bits wanted, 0 left")
        if len(text) > n:
            raise BitstreamError("invalid syntax value", "bin string has trailing bins")
        return int(text, 2) if text else 0

    if scheme == "FL":
        if len(bins) != _width(c_max):
            raise BitstreamError("invalid syntax value", "bin string has the wrong length")
        value = number(bins, len(bins))
    elif scheme == "TB":
        k = (c_max + 1).bit_length() - 1
        short = (2 << k) - (c_max + 1)
        if len(bins) == k and number(bins, k) < short:
            return number(bins, k)
        if len(bins) != k + 1:
            raise BitstreamError("invalid syntax value", "bin string has the wrong length")
        return number(bins, k + 1) - short & 0xFFFFFFFF  # a long form of a short value wraps
    elif scheme == "TR":
        if ones == len(bins):
            if ones != c_max >> rice:
                raise BitstreamError("invalid syntax value", "bin string has the wrong length")
            return c_max
        if len(bins) != ones + 1 + rice or not rice and ones == c_max:  # the ones of the maximum have no zero behind them
            raise BitstreamError("invalid syntax value", "bin string has the wrong length")
        value = (ones << rice) + number(bins[ones + 1 :], rice)
    elif scheme == "EG":
        if ones == len(bins):
            raise BitstreamError("unexpected end", "1 bits wanted, 0 left")
        return sum(1 << order + k for k in range(ones)) + number(bins[ones + 1 :], order + ones)
    else:
        if rice >= 32 or not 1 <= log2_range <= 28:
            raise BitstreamError("invalid syntax value", "parameters are out of range")
        most = 28 - log2_range
        prefix = min(ones, most)
        if prefix < most and ones == len(bins):
            raise BitstreamError("unexpected end", "1 bits wanted, 0 left")
        width = log2_range if prefix == most else prefix + rice
        value = (((1 << prefix) - 1) << rice) + number(bins[prefix + (prefix < most) :], width)
        if prefix < most and value >> rice > (2 << prefix) - 2:
            raise BitstreamError("invalid syntax value", "prefix and suffix are inconsistent")
        return value
    if value > c_max:
        raise BitstreamError("invalid syntax value", "value exceeds its maximum")
    return value
