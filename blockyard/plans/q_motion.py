"""Queries: robot motion (§2.7) and retries."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockyard.operators import motion as M
from blockyard.plans import views as V
from blockyard.plans.registry import query

TRAJ_SQL = """
, seg AS (SELECT *, sum(CASE WHEN kind IN ('MovementCommand', 'HomeCommand') THEN 1 ELSE 0 END)
                    OVER (PARTITION BY robot ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sg
          FROM commands),
traj AS (
  SELECT robot, seq, kind,
         first_value(CASE WHEN kind = 'MovementCommand' THEN coalesce(x, 0.0) ELSE 0.0 END)
           OVER (PARTITION BY robot, sg ORDER BY seq)
         + sum(CASE WHEN kind = 'RelativeMovementCommand' THEN coalesce(x, 0.0) ELSE 0.0 END)
           OVER (PARTITION BY robot, sg ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS px,
         first_value(CASE WHEN kind = 'MovementCommand' THEN coalesce(y, 0.0) ELSE 0.0 END)
           OVER (PARTITION BY robot, sg ORDER BY seq)
         + sum(CASE WHEN kind = 'RelativeMovementCommand' THEN coalesce(y, 0.0) ELSE 0.0 END)
           OVER (PARTITION BY robot, sg ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS py,
         first_value(CASE WHEN kind = 'MovementCommand' THEN coalesce(z, 0.0) ELSE 0.0 END)
           OVER (PARTITION BY robot, sg ORDER BY seq)
         + sum(CASE WHEN kind = 'RelativeMovementCommand' THEN coalesce(z, 0.0) ELSE 0.0 END)
           OVER (PARTITION BY robot, sg ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pz,
         first_value(CASE WHEN kind = 'MovementCommand' THEN coalesce(r, 0.0) ELSE 0.0 END)
           OVER (PARTITION BY robot, sg ORDER BY seq)
         + sum(CASE WHEN kind = 'RelativeMovementCommand' THEN coalesce(r, 0.0) ELSE 0.0 END)
           OVER (PARTITION BY robot, sg ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pr,
         coalesce(last_value(suck IGNORE NULLS) OVER (PARTITION BY robot ORDER BY seq
                                                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS suction
  FROM seg)"""


def _last(kinds: str, field: str, first: str) -> str:
    return f"""coalesce(last_value(CASE WHEN kind IN ({kinds}) THEN {field} END IGNORE NULLS)
      OVER (PARTITION BY robot ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), {first})"""


STATES_SQL = f"""
, states AS (SELECT robot, seq,
  {_last("'MovementSpeedCommand'", "speed", "50.0::DOUBLE")} AS speed,
  {_last("'MovementSpeedCommand'", "acceleration", "100.0::DOUBLE")} AS acceleration,
  {_last("'MoveConveyorCommand', 'RunConveyorCommand'", "speed", "0.0::DOUBLE")} AS conveyor_speed,
  {_last("'MoveConveyorCommand'", "distance", "0.0::DOUBLE")} AS conveyor_distance,
  {_last("'MoveConveyorCommand', 'RunConveyorCommand'", "direction", "NULL")} AS conveyor_direction
FROM robot_commands)
SELECT * FROM traj JOIN states USING (robot, seq)"""


@query("trajectory", TRAJ_SQL.replace("FROM commands)", "FROM robot_commands)") + STATES_SQL, ("robot_commands",))
def q_trajectory(spark, sf):
    return M.trajectory(V.robot_commands(spark, sf))


@query("final_position", TRAJ_SQL + """
SELECT robot, max(seq) AS n_commands, arg_max(px, seq) AS px, arg_max(py, seq) AS py, arg_max(pz, seq) AS pz,
       arg_max(pr, seq) AS pr, arg_max(suction, seq) AS suction
FROM traj GROUP BY robot""", ("commands",))
def q_final_position(spark, sf):
    return M.final_position(V.commands(spark, sf))


@query("state_change_only", """
SELECT robot, seq, suck FROM (
  SELECT robot, seq, suck, lag(suck) OVER (PARTITION BY robot ORDER BY seq) AS prev,
         row_number() OVER (PARTITION BY robot ORDER BY seq) AS rn
  FROM commands WHERE kind = 'SuctionCupCommand')
WHERE rn = 1 OR prev IS DISTINCT FROM suck""", ("commands",))
def q_state_change(spark, sf):
    c = V.commands(spark, sf).filter(F.col("kind") == "SuctionCupCommand").select("robot", "seq", "suck")
    return M.state_change_only(c, ["robot"], "seq", ["suck"], stage=True)


RETRY_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("retry_attempts", """
, a AS (SELECT *, CAST(row_number() OVER (PARTITION BY order_key, activity
                        ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS BIGINT) AS attempt
        FROM attempts),
b AS (SELECT *, min(attempt) FILTER (WHERE success OR NOT technical) OVER (PARTITION BY order_key, activity) AS ok FROM a)
SELECT order_key, activity, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, attempt,
       3 - attempt AS retries_left, success OR NOT technical OR attempt = 3 AS final,
       CASE WHEN success THEN 'success' WHEN NOT technical THEN 'refused' WHEN attempt = 3 THEN 'error' ELSE 'retry' END AS outcome,
       success
FROM b WHERE attempt <= least(coalesce(ok, 3), 3)""", ("attempts",))
def q_retry(spark, sf):
    return M.retry_attempts(V.attempts(spark, sf), ["order_key", "activity"], RETRY_ORDER, 3, "technical")
