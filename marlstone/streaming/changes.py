"""Changes of view as a stream that takes back what a late note makes untrue.

State is kept by (target, institution): the views so far, in the order of the
batch question.  A view that comes late has a new "previous" and becomes the
"previous" of another; the changes that no longer hold are sent again with
``sign`` -1, the new ones with +1.  Whatever the order of arrival, the changes
whose signs sum to 1 are the answer of ``analytics.detect_changes``.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KEY = ("target_key", "institution")
VIEW = ("date", "file_path", "line_number", "match_no", "rating", "target_price", "action")
CHANGES = "target_key string, institution string, date string, file_path string, line_number int, match_no int, previous_rating string, current_rating string, previous_target_price string, current_target_price string, change_type string, sign int"


def changes_of(views: list[tuple]) -> list[tuple]:
    """The changes among the views of one target and institution, in order; the rule of the batch question."""
    out, before = [], None
    for view in sorted(views, key=lambda v: v[:4]):
        *place, rating, price, action = view
        other_rating, other_price = (before is None or before[0] != rating), (before is None or before[1] != price)
        kind = action or ("首次覆盖" if before is None else "目标价变化" if other_price else "评级变化")
        if action or other_rating or other_price:
            out.append((*place, *(before and before[:1] or (None,)), rating, *(before and before[1:] or (None,)), price, kind))
        before = (rating, price)
    return out


def _revise(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = [tuple(v) for v in json.loads(state.get[0])] if state.exists else []
    new = [tuple(None if pd.isna(x) else x.item() if hasattr(x, "item") else x for x in v) for frame in frames for v in frame[list(VIEW)].itertuples(index=False, name=None)]
    was, now = Counter(changes_of(held)), Counter(changes_of(held + new))
    state.update((json.dumps(held + new, ensure_ascii=False),))
    rows = [(*key, *change, sign) for some, sign in ((was - now, -1), (now - was, 1)) for change, n in some.items() for _ in range(n)]
    yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in CHANGES.split(", ")])


def revised_changes(views: DataFrame) -> DataFrame:
    """``views``: a stream of mentions (target_key, institution, date, place, rating, target_price, action)."""
    given = views.where("coalesce(rating, '') <> '' or coalesce(target_price, '') <> ''").selectExpr(*KEY, *VIEW[:4], *(f"{c}" for c in VIEW[4:6]), "nullif(action, '') as action")
    return given.groupBy(*KEY).applyInPandasWithState(_revise, CHANGES, "views string", "append", GroupStateTimeout.NoTimeout)
