"""The counterpart of the arithmetic decoder: slice data made by answering what its reader asks."""

from __future__ import annotations

from collections.abc import Callable

from .bits import BitWriter
from .entropy import Entropy
from .model import AFTER_LPS, LPS_RANGES, Contexts, begun, context_place


class Recorder(Entropy):
    """Answers every question with ``choose(name, increment)`` and codes the answer; bypass bins are called ``bypass``.

    ``last`` says how many units the slice has: the end flag of the last one is set.
    """

    def __init__(self, choose: Callable[[str, int], int], init_type: int, qp: int, last: int = 1) -> None:
        self.choose, self.init_type, self.left = choose, init_type, last
        self.contexts = Contexts(begun(init_type, qp))
        self.low, self.range, self.waiting, self.first = 0, 510, 0, True
        self.out = BitWriter()

    def bin(self, name: str, inc: int) -> int:
        value, context = self.choose(name, inc), self.contexts[context_place(name, self.init_type, inc)]
        lps = LPS_RANGES[context.state][self.range >> 6 & 3]
        self.range -= lps
        if value == context.mps:
            context.state = min(context.state + 1, 62) if context.state < 62 else context.state
        else:
            self.low, self.range = self.low + self.range, lps
            if context.state == 0:
                context.mps = 1 - context.mps
            context.state = AFTER_LPS[context.state]
        self._grow()
        return value

    def bypass(self) -> int:
        value = self.choose("bypass", 0)
        self.low = 2 * self.low + value * self.range
        if self.low >= 1024:
            self._put(1)
            self.low -= 1024
        elif self.low < 512:
            self._put(0)
        else:
            self.low -= 512
            self.waiting += 1
        return value

    def terminate(self) -> int:
        self.left -= 1
        self.range -= 2
        if self.left:
            self._grow()
            return 0
        self.low, self.range = self.low + self.range, 2
        self._grow()
        self._put(self.low >> 9 & 1)
        self.out.u(2, self.low >> 7 & 3 | 1)  # the last bit is the stop bit
        return 1

    def _grow(self) -> None:
        while self.range < 256:
            if self.low < 256:
                self._put(0)
            elif self.low >= 512:
                self.low -= 512
                self._put(1)
            else:
                self.low -= 256
                self.waiting += 1
            self.range, self.low = 2 * self.range, 2 * self.low

    def _put(self, bit: int) -> None:
        if self.first:
            self.first = False
        else:
            self.out.u(1, bit)
        self.out.u(self.waiting, 0 if bit else (1 << self.waiting) - 1)
        self.waiting = 0

    def bytes(self) -> bytes:
        return self.out.bytes()
