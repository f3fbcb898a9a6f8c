"""Tables that the change engine serves: their fields, and the rules of a create.

A table has ``id``, ``user_id`` (its owner), its fields, ``created_at`` and
``updated_at``.
"""

from __future__ import annotations

from typing import Callable, NamedTuple

from pyspark.sql import Column

from .. import schemas as S
from ..functions import rules as R

# Kinds of a field in a request's JSON body.
TEXT, DATE, WHOLE, NUMBER = "text", "date", "whole", "number"


class Field(NamedTuple):
    name: str
    kind: str
    required: bool = True      # a create must send it; a patch may not send null
    patchable: bool = False
    positive: bool = False     # a patch to zero or less is invalid
    max_len: int | None = None


class Entity(NamedTuple):
    fields: list[Field]
    rules: Callable[[], list[tuple[str, Column]]]
    checked: list[str] = []    # text that a patch may send, never stored

    @property
    def columns(self) -> list[str]:
        return ["id", "user_id", *[f.name for f in self.fields], "created_at", "updated_at"]

    @property
    def patchable(self) -> list[Field]:
        return [f for f in self.fields if f.patchable]


LOG = Entity([Field("workout_date", DATE), Field("duration_min", WHOLE, patchable=True, positive=True),
              Field("intensity", TEXT, patchable=True, max_len=S.LOG_TEXT_MAX_LEN),
              Field("workout_type", TEXT, patchable=True, max_len=S.LOG_TEXT_MAX_LEN),
              Field("calories_burned", NUMBER, required=False)], R.log_rules, ["equipment_used"])

#: R-2: a run, with distance, duration and, where it was measured, the heart rate.
RUN = Entity([Field("run_date", DATE), Field("distance_km", NUMBER, patchable=True, positive=True),
              Field("duration_min", WHOLE, patchable=True, positive=True),
              Field("heart_rate", WHOLE, required=False, patchable=True, positive=True)], R.run_rules)
