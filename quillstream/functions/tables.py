"""Table functions: rows of sessions and of turns, callable from SQL.

``session_turns(uid, sessions, turns)`` gives a row for each session and turn of a prompt, in a lateral join.
``turn_positions(TABLE(t), 'key', 'turn')`` passes a table's rows through, one conversation
after the other, with what only their order tells: any table will do, the columns of the result follow it.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import IntegerType, LongType, Row, StringType, StructType


@udtf(returnType="session int, turn int, key string")
class SessionTurns:
    """Null prompts are an empty id; no sessions or turns give no rows."""

    def eval(self, uid: str, sessions: int, turns: int):
        for s in range(sessions or 0):
            for t in range(turns or 0):
                yield s, t, f"{'' if uid is None else uid}_{s}_{t}"


@udtf
class TurnPositions:
    """The rows of a table and, of each in its conversation: ``position``, ``ahead`` (characters of earlier
    turns), ``run`` (turns of this role in a row) and ``follows`` (the role before).

    Needs columns role and text; null texts have no characters.
    """

    def __init__(self):
        self.position, self.ahead, self.run, self.role = 0, 0, 0, None

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, order: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the first argument is a table")
        if missing := {"role", "text", key.value, order.value} - set(rows.dataType.names):
            raise ValueError(f"missing columns: {sorted(missing)}")
        schema = StructType(list(rows.dataType.fields))
        for name, kind in (("position", IntegerType()), ("ahead", LongType()), ("run", IntegerType()), ("follows", StringType())):
            schema = schema.add(name, kind)
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn(key.value)], orderBy=[OrderingColumn(order.value)])

    def eval(self, rows: Row, key: str, order: str):
        self.run = self.run + 1 if self.position and rows["role"] == self.role else 1
        yield (*rows, self.position, self.ahead, self.run, self.role)
        self.position += 1
        self.ahead += len(rows["text"] or "")
        self.role = rows["role"]


def register(spark: SparkSession) -> None:
    """Make both functions known to a session's SQL."""
    from quillstream.shipping import ship

    ship(spark)
    spark.udtf.register("session_turns", SessionTurns)
    spark.udtf.register("turn_positions", TurnPositions)
