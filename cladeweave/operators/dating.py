"""Calibrations, smoothing choice, replicate plans and age summaries."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def calibration_lines(calibrations: DataFrame, taxonomy: DataFrame, tips: DataFrame, columns: list[str]) -> DataFrame:
    """Configuration lines of the calibrations in use whose group has two tips or more.

    ``calibrations``: ``mrca, column, value, min, max, used_in_analysis``; ``taxonomy``: ``taxon`` and
    the named columns; ``tips``: ``taxon``.
    """
    long = taxonomy.unpivot("taxon", columns, "column", "value").distinct().join(tips.select("taxon").distinct(), "taxon", "left_semi")
    used = calibrations.where("used_in_analysis").select("mrca", "column", "value", "min", "max")
    groups = used.join(long, ["column", "value"]).groupBy("mrca", "min", "max").agg(F.array_sort(F.collect_set("taxon")).alias("tips")).where(F.size("tips") >= 2)
    lines = F.array(
        F.concat(F.lit("mrca = "), "mrca", F.lit(" "), F.array_join("tips", " ")),
        F.format_string("min = %s %f", "mrca", F.col("min").cast("double")),
        F.format_string("max = %s %f", "mrca", F.col("max").cast("double")),
    )
    return groups.select("mrca", F.posexplode(lines).alias("line_no", "line"))


def calibration_config(lines: DataFrame, num_sites: int, threads: int) -> str:
    """The whole configuration file."""
    rows = lines.orderBy("mrca", "line_no").select("line").collect()
    return "\n".join([f"numsites = {num_sites}", *(r[0] for r in rows), f"nthreads = {threads}", "thorough"]) + "\n"


def best_smoothing(scores: DataFrame) -> DataFrame:
    """Per run the smoothing value of least chi-square; equal scores give the smaller value."""
    return scores.groupBy("run").agg(F.min(F.struct("chi_square", "smoothing")).alias("b")).select("run", F.col("b.smoothing").alias("smoothing"), F.col("b.chi_square").alias("chi_square"))


def last_smoothing(config: DataFrame) -> DataFrame:
    """The value of the last ``smoothing =`` line of each run's configuration ``run, line_no, line``."""
    hit = config.where(F.col("line").rlike(r"^\s*smoothing\s*="))
    return hit.groupBy("run").agg(F.max_by(F.regexp_extract("line", r"=\s*([0-9.eE+-]+)", 1), "line_no").cast("double").alias("smoothing"))


def priming_mode(runs: DataFrame) -> DataFrame:
    """The commonest option set of the priming runs; equal numbers give the first in order."""
    counts = runs.groupBy("options").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "options").limit(1)


def bootstrap_plan(spark, base_seed: int = 111, step: int = 1000, replicates: int = 4, trees: int = 500) -> DataFrame:
    """Seed and size of each replicate."""
    i = F.col("replicate")
    return spark.range(1, replicates + 1).select(F.col("id").cast("int").alias("replicate")).select("replicate", (base_seed + i * step).alias("seed"), F.lit(trees).alias("trees"))


def bootstrap_script(plan: DataFrame, command: str, cpus: int = 120, workers: int = 20, memory: str = "32G", days: int = 7) -> str:
    """A batch script that runs every replicate of a plan."""
    head = ["#!/bin/bash", f"#SBATCH --cpus-per-task={cpus}", f"#SBATCH --mem={memory}", f"#SBATCH --time={days}-00:00:00", ""]
    runs = [f"{command} --seed {r['seed']} --bs-trees {r['trees']} --workers {workers} --prefix rep_{r['replicate']}" for r in plan.orderBy("replicate").collect()]
    return "\n".join(head + runs) + "\n"


def replicate_configs(trees: DataFrame, n: int, seed: int, smoothing: float, num_sites: int = 12700) -> DataFrame:
    """One configuration for each of ``n`` trees drawn without replacement, by the MD5 of ``seed:tree_no``."""
    order = F.md5(F.concat_ws(":", F.lit(int(seed)), "tree_no"))
    drawn = trees.select("tree_no", order.alias("_o")).orderBy("_o", "tree_no").limit(n)
    text = F.format_string(f"treefile = rep_%d.tre\nsmooth = {smoothing:g}\nnumsites = {num_sites}\noutfile = rep_%d.dated.tre", "tree_no", "tree_no")
    return drawn.select("tree_no", text.alias("config"))


def age_intervals(ages: DataFrame, share: float = 0.95) -> DataFrame:
    """Mean age and the shortest interval that holds ``share`` of the replicate ages of each node."""
    order = Window.partitionBy("node").orderBy("age", "rep")
    ranked = ages.withColumn("_r", F.row_number().over(order)).withColumn("_n", F.count("*").over(Window.partitionBy("node")))
    k = F.ceil(share * F.col("_n")).cast("int")
    ends = ranked.select("node", F.col("_r").alias("_end"), F.col("age").alias("high"))
    spans = ranked.withColumn("_end", F.col("_r") + k - 1).join(ends, ["node", "_end"])
    best = spans.groupBy("node").agg(F.min(F.struct((F.col("high") - F.col("age")).alias("w"), F.col("age").alias("low"), "high")).alias("b"))
    return ages.groupBy("node").agg(F.avg("age").alias("mean_age"), F.count("*").alias("n")).join(best, "node").select("node", "n", "mean_age", F.col("b.low").alias("hpd_low"), F.col("b.high").alias("hpd_high"))


def priming_config(base: str, tree_file: str, prefix: str) -> str:
    """The configuration ``base`` with a tree and the order to find optimiser options."""
    return _with_tree(base, tree_file, prefix) + "prime\n"


def cross_validation_config(base: str, tree_file: str, prefix: str, options: list[str], start: float = 1000.0, stop: float = 0.001) -> str:
    """The configuration with primed options and the order to cross-validate smoothing values."""
    more = [*options, f"cvstart = {start:g}", f"cvstop = {stop:g}", f"cvoutfile = cv_{prefix}", "cv", "randomcv"]
    return _with_tree(base, tree_file, prefix) + "\n".join(more) + "\n"


def final_config(base: str, tree_file: str, prefix: str, options: list[str], smoothing: float) -> str:
    return _with_tree(base, tree_file, prefix) + "\n".join([*options, f"smooth = {smoothing:g}"]) + "\n"


def _with_tree(base: str, tree_file: str, prefix: str) -> str:
    kept = [x for x in base.splitlines() if x.strip() and not re.match(r"\s*(treefile|outfile|smooth|prime|cv\w*|randomcv|opt\w*)\b", x)]
    return "\n".join([f"treefile = {tree_file}", *kept, f"outfile = treepl_{prefix}.tre"]) + "\n"


def primed_options(outputs: list[str]) -> list[str]:
    """The commonest set of ``opt`` lines of the priming runs' outputs; equal numbers give the first in order."""
    sets = Counter(tuple(x.strip() for x in out.splitlines() if re.match(r"\s*opt\w*\s*=", x)) for out in outputs)
    sets.pop((), None)
    if not sets:
        raise ValueError("no priming run gave options")
    return list(min(sets, key=lambda k: (-sets[k], k)))


def cross_validated_smoothing(output: str) -> float:
    """The smoothing value of least chi-square in lines ``chisq: (value) score``; equal scores give the smaller value."""
    found = [(float(score), float(value)) for value, score in re.findall(r"\(([0-9.eE+-]+)\)\s+([0-9.eE+-]+)", output)]
    if not found:
        raise ValueError("no cross-validation scores")
    return min(found)[1]


def date_tree(run: Callable[[str, str], str], base: str, tree_file: str, prefix: str, primings: int = 100) -> tuple[str, float, list[str]]:
    """Prime, cross-validate and date one tree: the last output, the smoothing and the options.

    ``run(configuration, name)`` executes the dating program and returns what it wrote.
    """
    options = primed_options([run(priming_config(base, tree_file, prefix), f"prime_{k}") for k in range(primings)])
    smoothing = cross_validated_smoothing(run(cross_validation_config(base, tree_file, prefix, options), "cv"))
    return run(final_config(base, tree_file, prefix, options, smoothing), "final"), smoothing, options


def date_replicates(trees: DataFrame, run: Callable[[str, str], str], base: str, options: list[str], smoothing: float, n: int | None = None, seed: int = 2025, factor: float = 100.0) -> DataFrame:
    """``tree_no, dated, status`` of ``n`` replicate trees ``tree_no, newick`` drawn without replacement.

    Every tree is dated in a task with the options and the smoothing of the best tree; a failure is kept in
    its row and does not stop the others.  ``factor`` multiplies the branch lengths first.
    """
    order = F.md5(F.concat_ws(":", F.lit(int(seed)), "tree_no"))
    drawn = trees.select("tree_no", "newick", order.alias("_o")).orderBy("_o", "tree_no")
    drawn = (drawn.limit(n) if n is not None else drawn).drop("_o")

    def one(frames):
        import pandas as pd

        for pdf in frames:
            rows = []
            for number, newick in zip(pdf.tree_no, pdf.newick, strict=True):
                name = f"BS_{number}"
                try:
                    scaled = rescaled_newick(newick, factor)
                    rows.append((number, run(final_config(base, scaled, name, options, smoothing), name), "OK"))
                except Exception as e:  # noqa: BLE001  whatever stops the program belongs in the row
                    rows.append((number, None, f"ERROR: {e}"))
            yield pd.DataFrame(rows, columns=["tree_no", "dated", "status"])

    return drawn.withColumn("tree_no", F.col("tree_no").cast("long")).mapInPandas(one, "tree_no long, dated string, status string")


def rescaled_newick(newick: str, factor: float) -> str:
    """A tree text with all branch lengths multiplied."""
    from cladeweave.sources.formats import format_newick, parse_newick

    return format_newick([(n, p, label, None if x is None else x * factor, *rest) for n, p, label, x, *rest in parse_newick(newick)])
