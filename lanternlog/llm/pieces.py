"""The pre-tokenizer of byte-level BPE vocabularies as a finite-state transducer over character classes.

It marks where pieces start. Texts are cut into chunks of equal length, each chunk's map from every state to its last
state is computed for all chunks at once, and the maps compose through a parallel prefix scan, so that each chunk's first
state is known without reading what stands before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np

# Symbols of the first transducer.
LETTER, NUMBER, OTHER, CUT2, CUT3, SPACE_END, SPACE, WHITE_END, WHITE, STOP = range(10)
# Its states: nothing open, a run of letters, numbers or others, a space that the next run takes in, white space that
# goes on, one or two letters of a contraction to come, and a piece that is complete.
FREE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, LEAD, IN_WHITE, ONE_LEFT, TWO_LEFT = range(8)
STATES = 8


def _piece_table() -> tuple[np.ndarray, np.ndarray]:
    """(next state, 1 where a piece starts) by state and symbol."""
    nxt, start = np.zeros((STATES, 10), np.int8), np.ones((STATES, 10), np.int8)
    for s in range(STATES):
        for sym, run in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS)):
            nxt[s, sym], start[s, sym] = run, s not in (run, LEAD)
        if s in (ONE_LEFT, TWO_LEFT):
            nxt[s, LETTER], start[s, LETTER] = (FREE if s == ONE_LEFT else ONE_LEFT), 0
        for sym, left in ((CUT2, ONE_LEFT), (CUT3, TWO_LEFT)):  # an apostrophe counts as one only where a piece starts
            inside = s in (IN_OTHERS, LEAD)
            nxt[s, sym], start[s, sym] = (IN_OTHERS if inside else left), not inside
        nxt[s, SPACE_END] = LEAD
        nxt[s, WHITE_END] = FREE
        for sym in (SPACE, WHITE):
            nxt[s, sym], start[s, sym] = IN_WHITE, s != IN_WHITE
        nxt[s, STOP], start[s, STOP] = FREE, 0
    return nxt, start


NEXT, STARTS = _piece_table()


def compose(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Maps of states (one a row): first, then second."""
    return np.take_along_axis(second, first.astype(np.intp), axis=1)


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """Row i becomes the composition of rows 0 to i, in log2(rows) rounds."""
    out, step = maps.copy(), 1
    while step < len(out):
        out[step:] = compose(out[:-step], out[step:])
        step *= 2
    return out


def piece_starts(symbols: np.ndarray, chunk: int = 256) -> np.ndarray:
    """1 where a piece starts, for a row of symbols that begins in the free state."""
    n = len(symbols)
    rows = max(1, -(-n // chunk))
    grid = np.full(rows * chunk, STOP, np.int8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(rows, chunk).T)
    flat = NEXT.ravel()
    maps = np.tile(np.arange(STATES, dtype=np.int8), (rows, 1))
    for col in grid:
        maps = flat[maps.astype(np.int16) * 10 + col[:, None]]
    state = np.zeros(rows, np.int8)
    state[1:] = prefix_scan(maps)[:-1, FREE]
    out, starts = np.empty((chunk, rows), np.int8), STARTS.ravel()
    for j, col in enumerate(grid):
        at = state.astype(np.int16) * 10 + col
        out[j], state = starts[at], flat[at]
    return np.ascontiguousarray(out.T).ravel()[:n]


def class_table(runs: Callable[[str, str], Iterable[str]]) -> np.ndarray:
    """Class of every code point, as a library's own expressions tell them apart: runs(pattern, text) finds their matches."""
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    classes = np.full(0x110000, OTHER, np.int8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\s")):
        for run in runs(pattern, everything):
            classes[np.frombuffer(run.encode("utf-32-le"), np.uint32)] = kind
    classes[0xD800:0xE000] = STOP
    return classes


def symbols(classes: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """The transducer's symbols of code points: their class, for white space also whether something solid comes next, for an
    apostrophe whether the letters of a contraction do."""
    out = classes[chars]
    after = np.append(chars[1:], 0xD800)
    white = out == WHITE
    solid_next = np.append(out[1:], STOP)
    solid_next = (solid_next != WHITE) & (solid_next != STOP)
    space = chars == 32
    out = np.where(white, np.where(space, np.where(solid_next, SPACE_END, SPACE), np.where(solid_next, WHITE_END, WHITE)), out).astype(np.int8)
    quote = np.flatnonzero(chars == 39)
    if len(quote):
        one = after[quote]
        two = np.append(chars, [0xD800, 0xD800])[quote + 2]
        is_in = lambda x, s: np.isin(x, [ord(c) for c in s])
        out[quote[is_in(one, "stmd")]] = CUT2
        long = (is_in(one, "r") & (two == ord("e"))) | (is_in(one, "v") & (two == ord("e"))) | (is_in(one, "l") & (two == ord("l")))
        out[quote[long]] = CUT3
    return out


def split(texts: list[str], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all texts with stops between them, first byte, end byte and text number of each piece)."""
    whole = "\ud800".join([*texts, ""])
    data = np.frombuffer(whole.encode("utf-8", "surrogatepass"), np.uint8)
    chars = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    syms = symbols(classes, chars)
    starts = np.flatnonzero(piece_starts(syms))
    width = np.ones(len(chars), np.int8)
    for least in (0x80, 0x800, 0x10000):
        width += chars >= least
    offset = np.zeros(len(chars) + 1, np.int64)
    np.cumsum(width, out=offset[1:])
    # A piece ends where the next one or a stop begins.
    stops = np.flatnonzero(syms == STOP)
    ends = np.minimum(np.append(starts[1:], len(chars)), stops[np.searchsorted(stops, starts)]) if len(starts) else starts
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
    return data, offset[starts], offset[ends], owner


def blocks(texts: Iterable[str | None], most: int) -> Iterable[list[str]]:
    """Texts (nulls as empty) in lists of about `most` characters; a longer text comes alone."""
    part, chars = [], 0
    for x in texts:
        x = x or ""
        if part and chars + len(x) > most:
            yield part
            part, chars = [], 0
        part.append(x)
        chars += len(x)
    if part:
        yield part
