"""The model of the arithmetic decoder: ranges and states of its bins, and the contexts of every syntax element.

Contexts stand in one vector, syntax element after syntax element; within an element the values of the three
initialization types follow one another. A context is found from its element, the type and an increment.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

from .bits import BitReader, BitstreamError
from .entropy import Arithmetic, Context

# The probability of the less probable symbol shrinks from 0.5 to 0.01875 over 63 states. A range is the
# rounded product with the middle of its quarter, 128 at most in the first and 6 at least, but for these few.
_SHRINK = (0.01875 / 0.5) ** (1 / 63)
_OTHER = {(3, 2): 178, (4, 2): 169, (4, 3): 195, (14, 3): 116, (20, 3): 85, (41, 2): 25}


def _product(state: int, quarter: int) -> int:
    value = int(0.5 * _SHRINK**state * (287 + 64 * quarter) + 0.5)
    return _OTHER.get((state, quarter), min(max(value, 6), 128 if quarter == 0 else 255))


def _ranges(state: int) -> list[int]:
    """The ranges of a state by quarter. From state 32 on the first is the state's own number and the others are those
    of the quarter before, which is what is decoded here."""
    if state == 63:
        return [63, 2, 2, 2]
    if state >= 32:
        return [state, *(_product(state, q) for q in range(3))]
    return [_product(state, q) for q in range(4)]


LPS_RANGES = [_ranges(s) for s in range(64)]

# The state after the less probable symbol.
AFTER_LPS = [int(s) for s in "0 0 1 2 2 4 4 5 6 7 8 9 9 11 11 12 13 13 15 15 16 16 18 18 19 19 21 21 22 22 23 24 24 25 26 26 27 27 28 29 29 30 30 30 31 32 32 33 33 33 34 34 35 35 35 36 36 36 37 37 37 38 38 63".split()]

# The initial values of the contexts by syntax element. ``all``: as many for each of the three types;
# ``inter``: for types 1 and 2; ``inter`` with an odd number: one for type 0 as well. After a + the values that stand
# behind the rest, dealt the same way. ``24x154`` is 24 times 154.
INITIAL = """
sao_merge all 153 153 153
sao_type all 200 185 160
split_cu_flag all 139 141 157 107 139 126 107 139 126
cu_transquant_bypass_flag all 154 154 154
cu_skip_flag inter 197 185 201 197 185 201
pred_mode_flag inter 149 134
part_mode inter 184 154 139 154 154 154 139 154 154
prev_intra_luma_pred_flag all 184 154 183
intra_chroma_pred_mode all 63 152 152
rqt_root_cbf inter 79 79
merge_flag inter 110 154
merge_idx inter 122 137
inter_pred_idc inter 95 79 63 31 31 95 79 63 31 31
ref_idx inter 153 153 153 153
mvp_flag inter 168 168
split_transform_flag all 153 138 138 124 138 94 224 167 122
cbf_luma all 111 141 153 111 153 111
cbf_chroma all 94 138 182 154 149 107 167 154 149 92 167 154 + 154 154 154
abs_mvd inter 140 198 169 198
cu_qp_delta_abs all 154 154 154 154 154 154
transform_skip_flag all 139 139 139 + 139 139 139
last_sig_coeff_x_prefix all 110 110 124 125 140 153 125 127 140 109 111 143 127 111 79 108 123 63 125 110 94 110 95 79 125 111 110 78 110 111 111 95 94 108 123 108 125 110 124 110 95 94 125 111 111 79 125 126 111 111 79 108 123 93
last_sig_coeff_y_prefix all 110 110 124 125 140 153 125 127 140 109 111 143 127 111 79 108 123 63 125 110 94 110 95 79 125 111 110 78 110 111 111 95 94 108 123 108 125 110 124 110 95 94 125 111 111 79 125 126 111 111 79 108 123 93
coded_sub_block_flag all 91 171 134 141 121 140 61 154 121 140 61 154
sig_coeff_flag all 111 111 125 110 110 94 124 108 124 107 125 141 179 153 125 107 125 141 179 153 125 107 125 141 179 153 125 140 139 182 182 152 136 152 136 153 136 139 111 136 139 111 155 154 139 153 139 123 123 63 153 166 183 140 136 153 154 166 183 140 136 153 154 166 183 140 136 153 154 170 153 123 123 107 121 107 121 167 151 183 140 151 183 140 170 154 139 153 139 123 123 63 124 166 183 140 136 153 154 166 183 140 136 153 154 166 183 140 136 153 154 170 153 138 138 122 121 122 121 167 151 183 140 151 183 140 + 141 111 140 140 140 140
coeff_abs_level_greater1_flag all 140 92 137 138 140 152 138 139 153 74 149 92 139 107 122 152 140 179 166 182 140 227 122 197 154 196 196 167 154 152 167 182 182 134 149 136 153 121 136 137 169 194 166 167 154 167 137 182 154 196 167 167 154 152 167 182 182 134 149 136 153 121 136 122 169 208 166 167 154 152 167 182
coeff_abs_level_greater2_flag all 138 153 136 167 152 152 107 167 91 122 107 167 107 167 91 107 107 167
explicit_rdpcm_flag inter 139 139 + 139 139
explicit_rdpcm_dir_flag inter 139 139 + 139 139
cu_chroma_qp_offset_flag all 154 154 154
cu_chroma_qp_offset_idx all 154 154 154
log2_res_scale_abs_plus1 all 24x154
res_scale_sign_flag all 6x154
palette_mode_flag all 154 154 154
tu_residual_act_flag all 154 154 154
palette_run_prefix all 24x154
copy_above_palette_indices_flag all 154 154 154
palette_transpose_flag all 154 154 154
"""


class Element(NamedTuple):
    name: str
    base: int  # of its contexts in the vector
    values: list[int]
    start: list[int]  # by type, where its values begin; 0 for a type that has none
    count: list[int]
    behind: list[tuple[int, int]]  # by type, where the values behind the rest begin, and how many there are


@lru_cache(maxsize=1)
def elements() -> dict[str, Element]:
    out: dict[str, Element] = {}
    base = 0
    for line in INITIAL.strip().splitlines():
        name, dealt, *rest = line.split()
        parts: list[list[int]] = [[]]
        for word in rest:
            if word == "+":
                parts.append([])
            elif "x" in word:
                n, value = word.split("x")
                parts[-1] += [int(value)] * int(n)
            else:
                parts[-1].append(int(word))
        main, more = parts[0], parts[1] if len(parts) > 1 else []

        def share(n: int, dealt: str = dealt) -> list[int]:
            return [n // 3] * 3 if dealt == "all" else [n % 2, n // 2, n // 2]

        count, extra = share(len(main)), share(len(more))
        begin = lambda counts: [sum(counts[:k]) for k in range(3)]
        behind = [(len(main) + a, n) for a, n in zip(begin(extra), extra, strict=True)]
        out[name] = Element(name, base, main + more, begin(count), count, behind)
        base += len(main) + len(more)
    return out


def context_count() -> int:
    last = list(elements().values())[-1]
    return last.base + len(last.values)


def context_values(init_type: int) -> list[int | None]:
    """The initial values of all contexts of a type; null where the type has none."""
    if not 0 <= init_type <= 2:
        raise BitstreamError("invalid syntax value", "the initialization type must be 0, 1 or 2")
    out: list[int | None] = [None] * context_count()
    for e in elements().values():
        for start, n in ((e.start[init_type], e.count[init_type]), e.behind[init_type]):
            out[e.base + start : e.base + start + n] = e.values[start : start + n]
    return out


@lru_cache(maxsize=4096)
def context_place(name: str, init_type: int | None, increment: int) -> int:
    """The place in the vector of an element's context. Without a type increments count from the element's first
    context. The chroma flag's fourth depth and what stands behind the coefficient flags have places of their own."""
    e = elements()[name]
    if name == "cbf_chroma" and increment >= 12:
        at = increment
    elif name == "sig_coeff_flag" and increment >= 42:
        at = increment if init_type is None else 126 + 2 * init_type + increment - 42
    else:
        at = increment + (0 if init_type is None else e.start[init_type])
    if not 0 <= at < len(e.values):
        raise BitstreamError("invalid syntax value", f"no context {increment} of {name}")
    return e.base + at


@lru_cache(maxsize=256)
def begun(init_type: int, qp: int) -> list[Context]:
    """All contexts as they are at the begin of a slice."""
    return [Context(0, 0) if v is None else Context.initial(v, qp) for v in context_values(init_type)]


class Contexts(dict):
    """Contexts by their place, copied from the first ones when they are asked for: a slice uses few of them."""

    def __init__(self, first: list[Context], used: dict[int, Context] | None = None) -> None:
        super().__init__({k: Context(c.state, c.mps) for k, c in (used or {}).items()})
        self.first = first

    def __missing__(self, place: int) -> Context:
        c = self.first[place]
        made = self[place] = Context(c.state, c.mps)
        return made


class Standard(Arithmetic):
    """The arithmetic decoder with the contexts of all syntax elements, of an initialization type and a quantiser."""

    def __init__(self, reader: BitReader, init_type: int, qp: int) -> None:
        self.init_type = init_type
        super().__init__(reader, LPS_RANGES, AFTER_LPS)
        self.first = {"": begun(init_type, qp)}  # never changed: contexts are copies of it
        self.reset()

    def bin(self, name: str, inc: int) -> int:
        return self.decision(self.contexts[""][context_place(name, self.init_type, inc)])

    def reset(self) -> None:
        self.contexts, self.stored = {"": Contexts(self.first[""])}, None

    def store(self) -> None:
        self.stored = {"": Contexts(self.first[""], self.contexts[""])}

    def synchronize(self) -> bool:
        if self.stored is None:
            return False
        self.contexts = {"": Contexts(self.first[""], self.stored[""])}
        return True
