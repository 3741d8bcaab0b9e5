"""Lineage kept after a job: parquet folders per application and stage."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.lineage.frame import ID, LineageFrame, Stage, edge_of, structural_back
from tidemark.lineage.trace import _frames

_DAG = "app_id string, stage int, name string, kind string, parents array<int>, has_cost boolean, wide boolean, linked boolean"


def capped(records: DataFrame, limit: int, partition: Column, order: str = ID) -> DataFrame:
    """At most ``limit`` records per partition, smallest ids first: an upload bound on request."""
    place = Window.partitionBy(partition).orderBy(order)
    return records.withColumn("_place", F.row_number().over(place)).where(
        F.col("_place") <= limit
    ).drop("_place")


def save(root: LineageFrame, path: str, app_id: str) -> None:
    """Write records and edges of every stage, parents first.

    Each stage is computed from the stored records of its parents, so the work is that of one run.
    Input ids that an output's id holds are not written again, and where records are as their stage
    made them, the costs of their links stand beside them.
    """
    frames = _frames(root)
    numbers = {id(f): i for i, f in enumerate(frames)}
    spark = root.df.sparkSession
    base = f"{path}/app_id={app_id}"
    done: dict[int, LineageFrame] = {}
    wide: dict[int, bool] = {}
    linked: dict[int, bool] = {}

    def write(f: LineageFrame) -> LineageFrame:
        if id(f) not in done:
            i, stage = numbers[id(f)], f.stage
            if stage.kind == "source":
                frame = f
            else:
                frame = stage.build(*[write(p) for p in stage.parents])
                for step in f.narrow:
                    frame = step(frame)
            records = f"{base}/stage={i}/records"
            wide[i] = frame.stage.rows is not None and not frame.filtered
            linked[i] = wide[i] and not f.narrow
            (frame.stage.linked if linked[i] else frame.df).write.mode("overwrite").option("compression", "zstd").parquet(records)
            if wide[i] and not linked[i]:  # all sides at once, from one run of the join
                rows = frame.stage.rows.drop(*[f"in_{side}" for side in range(len(stage.parents))])
                rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{base}/stage={i}/rows")
            elif not wide[i]:
                for side, edges in enumerate(frame.inputs()):
                    edges.write.mode("overwrite").option("compression", "zstd").parquet(f"{base}/stage={i}/edges/side={side}")
            done[id(f)] = replace(frame, df=spark.read.schema(frame.df.schema).parquet(records))
        return done[id(f)]

    write(root)
    rows = [
        (app_id, i, f.stage.name, f.stage.kind, [numbers[id(p)] for p in f.stage.parents], f.has_cost, wide[i], linked[i])
        for i, f in enumerate(frames)
    ]
    spark.createDataFrame(rows, _DAG).coalesce(1).write.mode("overwrite").parquet(f"{base}/dag")


def load(spark: SparkSession, path: str, app_id: str) -> LineageFrame:
    """Rebuild the pipeline's stages for tracing, in any later session."""
    base = f"{path}/app_id={app_id}"
    dag = {r.stage: r for r in spark.read.schema(_DAG).parquet(f"{base}/dag").collect()}  # a row per stage
    built: dict[int, LineageFrame] = {}

    def build(i: int) -> LineageFrame:
        if i not in built:
            r = dag[i]
            parents = tuple(build(p) for p in r.parents)
            records, rows, back = spark.read.parquet(f"{base}/stage={i}/records"), None, structural_back(r.kind, len(parents))
            costs = [f"{cost}_{s}" for s in range(len(parents)) for cost in ("lat", "total")]
            if r.linked:
                rows = records.select(F.col(ID).alias("out_id"), *[F.col(f"_{c}").alias(c) for c in costs])
                records = records.drop(*[f"_{c}" for c in costs])
            elif r.wide:
                rows = spark.read.parquet(f"{base}/stage={i}/rows")
            if r.wide:
                rows = rows.withColumns({f"in_{s}": back[s](F.col("out_id")) for s in range(len(parents))})
            edges = tuple(
                edge_of(rows, s) if r.wide else spark.read.parquet(f"{base}/stage={i}/edges/side={s}")
                for s in range(len(parents))
            )
            stage = Stage(r.name, r.kind, parents, edges, rows, None, back)
            built[i] = LineageFrame(records, stage, has_cost=r.has_cost)
        return built[i]

    return build(0)


def dependencies(root: LineageFrame) -> list[tuple[int, str, str, int, list[int]]]:
    """(stage, name, kind, depth, parents) of a pipeline, parents first."""
    frames = _frames(root)
    numbers = {id(f): i for i, f in enumerate(frames)}

    def depth(f):
        return 0 if not f.stage.parents else 1 + max(depth(p) for p in f.stage.parents)

    rows = [
        (numbers[id(f)], f.stage.name, f.stage.kind, depth(f), [numbers[id(p)] for p in f.stage.parents])
        for f in frames
    ]
    return sorted(rows, key=lambda r: (r[3], r[0]))


def print_dependencies(root: LineageFrame) -> str:
    return "\n".join("  " * d + f"{kind} {name}" for _, name, kind, d, _ in dependencies(root))
