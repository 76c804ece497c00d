"""Cheapest edits that make conversations follow `(s?(ua)+)?`, for many at once: dynamic programming over time-major arrays.

A conversation is a column; axis 0 is time. Conversations of similar length share an array, aligned at their ends, so the padding lies before
them and passes costs through. States: 0 nothing yet, 1 after the system turn, 2 after a user turn, 3 after an assistant turn; a
state allows at most one of user and assistant, so an edit's letter fixes the next state. costs() goes backward over time with one vectorised step
a turn, for all four states; trace() goes forward and takes the first letter, in ASCII order, that keeps to the stored costs.

A stretch of a longer conversation is handled alike: its costs start from those of what follows it (`after`), and its trace from any state.
"""

from __future__ import annotations

import numpy as np

DELETE_COST, EDIT_COST = 4, 3
#: More than any conversation costs.
NEVER = 1 << 50
#: What a row is: nothing (padding), sound, to be deleted, cut off.
PADDING, SOUND, FAULTY, CUT = range(4)
#: Codes of role initials, others 3.
INITIALS = {"s": 0, "u": 1, "a": 2}
#: The state after the user or assistant turn that a state allows, and the role of that turn.
FOLLOWING = np.array([2, 2, 3, 2])
ROLE_IN = ("user", "user", "assistant", "user")
#: The state after a kept row by state and initial, -1 where the row can't stay.
KEPT = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
#: The costs where no row is left: nothing, two turns, one turn, nothing.
END = np.array([0, 2 * EDIT_COST, EDIT_COST, 0])
_D, _I, _K, _R = (ord(c) for c in "DIKR")


def align(owner: np.ndarray, place: np.ndarray, lengths: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """Columns of rows as arrays [time, conversation], zero in the padding. owner: conversation of a row; place: its place in it."""
    tall = int(lengths.max(initial=0))
    out = []
    for values in columns:
        wide = np.zeros((tall, len(lengths)), values.dtype)
        wide[tall - lengths[owner] + place, owner] = values
        out.append(wide)
    return out


def _with_inserts(base: np.ndarray) -> np.ndarray:
    """Costs [state, conversation] where up to two turns may be inserted first."""
    out = base.copy()
    out[2] = np.minimum(base[2], EDIT_COST + base[3])
    out[3] = np.minimum(base[3], EDIT_COST + base[2])
    out[:2] = np.minimum(base[:2], EDIT_COST + out[2])
    return out


def _choices(initial: np.ndarray, kind: np.ndarray, later: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs [state, conversation] of deleting, keeping and relabelling the row of one turn."""
    extra = np.where(kind == CUT, EDIT_COST, 0) + np.where(kind == FAULTY, NEVER, 0)
    after = KEPT[:, initial]
    keep = np.where(after < 0, NEVER, np.take_along_axis(later, np.maximum(after, 0), 0) + extra)
    return DELETE_COST + later, keep, EDIT_COST + extra + later[FOLLOWING]


def costs(initial: np.ndarray, kind: np.ndarray, after: np.ndarray) -> np.ndarray:
    """[time + 1, state, conversation]: the least cost from each state on. after: [state, conversation], the costs behind the last turn."""
    tall, wide = initial.shape
    out = np.empty((tall + 1, 4, wide), np.int64)
    out[tall] = after
    for t in range(tall - 1, -1, -1):
        best = np.minimum.reduce(_choices(initial[t], kind[t], out[t + 1]))
        out[t] = np.minimum(np.where(kind[t] == PADDING, out[t + 1], _with_inserts(best)), NEVER)
    return out


def trace(initial: np.ndarray, kind: np.ndarray, known: np.ndarray, start: np.ndarray, ends: bool) -> tuple[list[bytes], np.ndarray]:
    """The ASCII-least cheapest edits of each conversation, and its last state. ends: nothing follows, so missing turns are added behind the last row."""
    tall, wide = initial.shape
    letters, state, every = np.zeros((tall + 1, 3, wide), np.uint8), start.copy(), np.arange(wide)
    for t in range(tall):
        delete, keep, relabel = _choices(initial[t], kind[t], known[t + 1])
        waits = kind[t] != PADDING
        for k in range(3):
            cost = known[t, state, every]
            inserts = EDIT_COST + known[t, FOLLOWING[state], every] == cost
            picked = np.select([delete[state, every] == cost, inserts, keep[state, every] == cost], [_D, _I, _K], _R)
            letters[t, k] = np.where(waits, picked, 0)
            moved = np.select([picked == _D, picked == _K], [state, KEPT[state, initial[t]]], FOLLOWING[state])
            state = np.where(waits, moved, state)
            waits &= picked == _I
    if ends:
        for k in range(2):
            short = known[tall, state, every] > 0
            letters[tall, k] = np.where(short, _I, 0)
            state = np.where(short, FOLLOWING[state], state)
    flat = letters.transpose(2, 0, 1).reshape(wide, -1)
    written, at = flat[flat > 0].tobytes(), np.concatenate([[0], np.cumsum((flat > 0).sum(1))])
    return [written[at[n] : at[n + 1]] for n in range(wide)], state


def transfer(initial: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """[conversation, state before, state behind]: the least cost of a stretch between any two states."""
    out = np.empty((initial.shape[1], 4, 4), np.int64)
    for state in range(4):
        after = np.full((4, initial.shape[1]), NEVER)
        after[state] = 0
        out[:, :, state] = costs(initial, kind, after)[0].T
    return out


def replay(letters: bytes, state: int, roles: list[str], texts: list[str]) -> tuple[list[tuple[str, str]], int]:
    """The repaired (role, text) turns that edits make of rows, and the last state."""
    out, row = [], 0
    for letter in letters:
        if letter == _I:
            out.append((ROLE_IN[state], ""))
        elif letter != _D:
            out.append((roles[row] if letter == _K else ROLE_IN[state], texts[row]))
        if letter == _K:
            state = int(KEPT[state, INITIALS.get(roles[row][:1], 3)])
        elif letter != _D:
            state = int(FOLLOWING[state])
        row += letter != _I
    return out, state
