"""Keyed state over event time: labels whose tokens come in pieces, and logins counted over a sliding window."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

GATHERED = "inspection_id string, seq int, text string, confidence double, complete boolean"
ALERTS = "actor_id string, event_id long, ts timestamp, since timestamp"


#: Labels are gathered in so many groups by a hash of their inspection, since a call for each costs far more than its tokens.
GROUPS = 2048


def _gather(wait_ms: int):
    columns = ["inspection_id", "seq", "text", "confidence", "complete"]

    def run(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # by inspection: its tokens by seq, how many are expected, the time until which it is held, whether it was handed on
        held = {i: [{int(seq): token for seq, token in tokens}, *more] for i, tokens, *more in json.loads(state.get[0])} if state.exists else {}
        rows: list[tuple] = []

        def out(inspection: str | None, tokens: dict, complete: bool) -> None:
            rows.extend((inspection, seq, text, sure, complete) for seq, (text, sure) in sorted(tokens.items()))

        now, heard = state.getCurrentWatermarkMs(), set()
        for batch in () if state.hasTimedOut else batches:
            # columns of objects, where what is missing is None
            values = (batch[c].astype(object).where(batch[c].notna(), None) for c in ("inspection_id", "seq", "text", "confidence", "n_tokens", "ms"))
            for inspection, seq, text, sure, n, at in zip(*values):
                label = held.setdefault(inspection, [{}, 0, 0, False])
                heard.add(inspection)
                if not label[3]:
                    label[0].setdefault(int(seq), (text, sure))
                label[1], label[2] = max(label[1], int(n or 0)), max(label[2], int(at) + wait_ms)
        for inspection in heard:
            tokens, expected, until, decided = held[inspection]
            if not decided and expected and len(tokens) >= expected:
                out(inspection, tokens, True)
                tokens, decided = {}, True
            held[inspection] = [tokens, expected, max(until, now + 1), decided]
        for inspection in [i for i, label in held.items() if label[2] < now]:
            tokens, _, _, decided = held.pop(inspection)
            if not decided:
                out(inspection, tokens, False)
        if held:
            state.update((json.dumps([(i, list(tokens.items()), *more) for i, (tokens, *more) in held.items()]),))
            state.setTimeoutTimestamp(max(min(label[2] for label in held.values()), now + 1))
        elif state.exists:
            state.remove()
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    return run


def gather_labels(tokens: DataFrame, wait: int = 900, late: str = "10 minutes") -> DataFrame:
    """Tokens of a stream (inspection_id, seq, text, confidence, n_tokens, ts) handed on when their inspection is whole.

    An inspection's tokens may come in any order and over any number of batches. They are handed on once: as soon as
    ``n_tokens`` of them are there (complete), or, where that number is null or too few come, when the watermark, ``late``
    behind the newest token, is ``wait`` seconds past its last token (not complete). A token that comes twice counts
    once, the first text for a seq stays, and tokens for an inspection that was handed on are left out as long as its
    state lasts, which is until that same time; then the state goes. Tokens behind the watermark are dropped.

    The state holds an inspection's tokens (tens of lines) until it is whole, and after that only that it was. Inspections
    are dealt over GROUPS states, each a list of those that wait.
    """
    rows = tokens.withWatermark("ts", late).select("inspection_id", "seq", "text", "confidence", "n_tokens", "ts", F.unix_millis("ts").alias("ms"))
    rows = rows.withColumn("group", F.pmod(F.xxhash64("inspection_id"), F.lit(GROUPS)))
    return rows.groupBy("group").applyInPandasWithState(_gather(wait * 1000), GATHERED, "labels string", "append", GroupStateTimeout.EventTimeTimeout)


def _sliding(window_us: int, limit: int):
    def run(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        # attempts (microseconds, event_id, told), in order
        attempts = [tuple(a) for a in json.loads(state.get[0])] if state.exists else []
        for batch in batches:
            attempts += [(int(us), int(i), False) for us, i in zip(batch["us"], batch["event_id"])]
        attempts.sort()
        rows = []
        for k in range(limit, len(attempts)):
            us, event, told = attempts[k]
            if not told and us - attempts[k - limit][0] < window_us:
                rows.append((key[0], event, us, attempts[k - limit][0]))
                attempts[k] = (us, event, True)
        # before the watermark nothing can come in between: of what lies there the last ``limit`` still count
        settled = sum(us < state.getCurrentWatermarkMs() * 1000 for us, _, _ in attempts)
        attempts = attempts[max(0, settled - limit) :]
        if attempts:
            state.update((json.dumps(attempts),))
            state.setTimeoutTimestamp(max((attempts[-1][0] + window_us) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if rows:
            found = pd.DataFrame(rows, columns=["actor_id", "event_id", "ts", "since"])
            for c in ("ts", "since"):
                found[c] = pd.to_datetime(found[c], unit="us")
            yield found

    return run


def sliding_login_alerts(requests: DataFrame, window: int = 900, limit: int = 5, late: str = "1 day") -> DataFrame:
    """Logins beyond ``limit`` in the ``window`` seconds up to them, of each client: actor_id, event_id, ts, and ``since``,
    the time of the login ``limit`` before it as far as is known then. The window slides: it ends at every login, and its
    start is outside.

    An alert is given once, as soon as its logins are known, in append output. Logins may come in any order up to
    ``late`` behind the newest: one that comes late is counted where it belongs, and may bring alerts for later ones; one
    behind the watermark is dropped. The state of a client is its last ``limit`` logins before the watermark and those
    since; it goes when the watermark is a window past the last.
    """
    logins = requests.filter(F.col("path") == "/api/v1/auth/login").withWatermark("ts", late).select("actor_id", "event_id", "ts", F.unix_micros("ts").alias("us"))
    return logins.groupBy("actor_id").applyInPandasWithState(_sliding(window * 1_000_000, limit), ALERTS, "attempts string", "append", GroupStateTimeout.EventTimeTimeout)
