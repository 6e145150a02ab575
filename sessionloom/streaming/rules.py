"""Event-by-event rules whose state is a few fields.  The same rule runs in batch and in a stream.

A rule gets one event (dict) and its state (dict) and returns the new state and the rows to emit.  A
row of kind ``pause`` flushes and resets; events until ``resume`` are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

KEY, SCROLL = "key", "scroll"


@dataclass(frozen=True)
class Rule:
    """Base: subclasses give ``output`` (DDL), ``new_state`` and ``step``."""

    output = ""
    lasting = ()  # state fields that outlive a flush

    def new_state(self) -> dict:
        return {}

    def step(self, state: dict, event: dict) -> tuple[dict, list[tuple]]:
        raise NotImplementedError

    def flush(self, state: dict) -> list[tuple]:
        """Rows still owed when a pause or a timer ends the current burst."""
        return []

    def deadline(self, state: dict) -> float | None:
        """Event time at which the open burst ends by itself."""
        return None

    def feed(self, state: dict, event: dict) -> tuple[dict, list[tuple]]:
        """Timer, pause and resume handling around ``step``."""
        due = self.deadline(state)
        early = []
        if due is not None and event["ts"] > due:
            early = self.flush(state)
            state = {**self.new_state(), **{k: v for k, v in state.items() if k in self.lasting}}
        if event["kind"] == "pause":
            rows = early + self.flush(state)
            return {**self.new_state(), **{k: v for k, v in state.items() if k in self.lasting}, "paused": True}, rows
        if event["kind"] == "resume":
            return {k: v for k, v in state.items() if k != "paused"}, early
        if state.get("paused"):
            return state, early
        state, rows = self.step(state, event)
        return state, early + rows


@dataclass(frozen=True)
class KeyBursts(Rule):
    """Keyboard bursts: a fixed span from the first key, which later keys do not extend."""

    timeout: float = 2.0
    output = "burst_start double, first_line bigint, last_line bigint, n_keys bigint"

    def step(self, state, event):
        if not state.get("n"):
            state = {**state, "start": event["ts"], "first": event["line_no"], "n": 0}
        return {**state, "last": event["line_no"], "n": state["n"] + 1}, []

    def flush(self, state):
        return [(state["start"], state["first"], state["last"], state["n"])] if state.get("n") else []

    def deadline(self, state):
        return state["start"] + self.timeout if state.get("n") else None


@dataclass(frozen=True)
class ScrollThrottle(Rule):
    """Which scrolls are kept: the first of a burst, then by gap, distance and rate since the last kept one.

    A scroll refused for its rate still counts toward the rate once it was far enough.
    """

    min_gap: float = 0.5
    min_distance: float = 5.0
    max_rate: float = 10.0
    timeout: float = 2.0
    min_size: float = 1.0
    output = "line_no bigint"

    def step(self, state, event):
        ts, x, y = event["ts"], event["x"], event["y"]
        big = (event["dx"] ** 2 + event["dy"] ** 2) ** 0.5 >= self.min_size
        keep = [(event["line_no"],)] if big else []
        if state.get("start") is None or ts - state["start"] > self.timeout:
            return {"start": ts, "count": 0, "x": x, "y": y, "last": ts}, keep
        if ts - state["last"] < self.min_gap:
            return state, []
        if ((x - state["x"]) ** 2 + (y - state["y"]) ** 2) ** 0.5 < self.min_distance:
            return state, []
        state = {**state, "count": state["count"] + 1}
        span = ts - state["start"]
        if span > 0 and state["count"] / span > self.max_rate:
            return state, []
        return {**state, "x": x, "y": y, "last": ts}, keep


@dataclass(frozen=True)
class PressRelease(Rule):
    """Mouse press and release to a drag (same monitor, far enough) or a click at the press point."""

    min_distance: float = 5.0
    output = "press_line bigint, release_line bigint, action string, x double, y double, end_x double, end_y double"

    def step(self, state, event):
        if event["kind"] == "press":
            return {k: event[k] for k in ("x", "y", "button", "monitor", "line_no")}, []
        if not state or state.get("button") != event["button"]:
            return state, []
        far = ((event["x"] - state["x"]) ** 2 + (event["y"] - state["y"]) ** 2) ** 0.5 > self.min_distance
        drag = far and event["monitor"] == state["monitor"]
        end = (event["x"], event["y"]) if drag else (None, None)
        name = ("drag_" if drag else "click_") + event["button"]
        return {}, [(state["line_no"], event["line_no"], name, state["x"], state["y"], *end)]


@dataclass(frozen=True)
class RunMerge(Rule):
    """Run merging while events arrive; rows are numbered densely per session.

    Keys wait in the state until their run ends; a scroll equal to the scroll before it is dropped.
    Needs event fields kind (key, scroll, other), action, token, hotkey.
    """

    output = "run_id bigint, kind string, action string, ts_before double, ts_after double, n_events bigint"
    lasting = ("runs",)

    def _emit(self, state, kind, action, first, last, n):
        number = state.get("runs", 0) + 1
        return {**state, "runs": number}, (number, kind, action, first, last, n)

    def _close(self, state):
        if not state.get("tokens"):
            return state, []
        words = "".join(token[: max(0, len(token) - cuts)] for token, cuts in state["tokens"])
        n = sum(1 + cuts for _, cuts in state["tokens"])
        state, row = self._emit(state, KEY, f"key_press('{words}')", state["first"], state["last"], n)
        return {**state, "tokens": []}, [row]

    def step(self, state, event):
        rows = []
        if event["kind"] == KEY:
            if event["hotkey"]:
                state, rows = self._close(state)
            tokens = list(state.get("tokens") or [])
            if not tokens:
                state = {**state, "first": event["ts"]}
            if event["token"] == "Key.backspace" and tokens:
                tokens[-1] = [tokens[-1][0], tokens[-1][1] + 1]
            else:
                tokens.append([event["token"], 0])
            return {**state, "tokens": tokens, "last": event["ts"], "scroll": None}, rows
        state, rows = self._close(state)
        if event["kind"] == SCROLL and state.get("scroll") == event["action"]:
            return state, rows
        state, row = self._emit(state, event["kind"], event["action"], event["ts"], event["ts"], 1)
        return {**state, "scroll": event["action"] if event["kind"] == SCROLL else None}, rows + [row]

    def flush(self, state):
        return self._close(state)[1]

    def feed(self, state, event):
        owed = bool(state.get("tokens")) and event["kind"] == "pause"
        state_after, rows = super().feed(state, event)
        # A flushed run used up one number.
        return ({**state_after, "runs": state.get("runs", 0) + 1} if owed else state_after), rows
