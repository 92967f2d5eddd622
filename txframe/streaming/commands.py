"""Object commands as Structured Streaming: the stream forms of ``operators.commands``.

State is kept for each key: the version reached, the value, and the commands that wait for an
earlier one. What waits is held until its gap closes or an overwrite makes it void, so a key's
state grows with the commands that its gap holds up and with nothing else.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

APPLIED = "key long, version long, applied long, value long, waiting long"
STATE = "version long, applied long, value long, pending string"


def _apply(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    version, applied, value, kept = state.get if state.exists else (1, 0, 0, "[]")
    # by new_version, each once: (new_version, obj_version, overwrite, payload)
    pending = {c[0]: tuple(c) for c in json.loads(kept)}
    for part in parts:
        for new, old, overwrite, payload in zip(part.new_version, part.obj_version, part.overwrite, part.payload):
            if new > version:
                pending.setdefault(int(new), (int(new), int(old), bool(overwrite), int(payload)))
    order = sorted(pending.values())
    last = max((i for i, c in enumerate(order) if c[2]), default=None)
    if last is not None:
        version, applied, value = order[last][0], 1, order[last][3]
        order = order[last + 1 :]
    done = 0
    while done < len(order) and order[done][1] == version:
        version, applied, value = order[done][0], applied + 1, value + order[done][3]
        done += 1
    waiting = order[done:]
    state.update((version, applied, value, json.dumps(waiting)))
    yield pd.DataFrame({"key": [key[0]], "version": [version], "applied": [applied], "value": [value], "waiting": [len(waiting)]})


def ordered_apply(commands: DataFrame) -> DataFrame:
    """Per key and micro-batch with commands of it: where ordered application stands after it.

    ``commands`` is a stream of (key, new_version, obj_version, overwrite, payload), without nulls,
    in any order; repeats, and commands not after the version reached, are skipped. A key's last
    row equals the row that the batch operator gives over all that has arrived.
    """
    rows = commands.select("key", "new_version", "obj_version", "overwrite", "payload")
    return rows.groupBy("key").applyInPandasWithState(_apply, APPLIED, STATE, "update", GroupStateTimeout.NoTimeout)


def watermark_progress(progress: DataFrame) -> DataFrame:
    """Per subscribed group of a stream the greatest consistent time so far; the least of them is the watermark."""
    return progress.groupBy("seq_grp").agg(F.max("consistent_ts").alias("consistent_ts"), F.max("seq_id").alias("seq_id"))


def fanout(messages: DataFrame, subscribers: DataFrame) -> DataFrame:
    """Each message of a stream to every subscriber of its channel, a static table."""
    return messages.join(subscribers, "channel")
