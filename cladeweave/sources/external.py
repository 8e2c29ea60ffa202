"""Adapters around external programs and services.

Command builders are pure; ``run_grouped`` executes one command for each group in a task of its own
and fails loudly.  Nothing here stands in for a program's results.
"""

from __future__ import annotations

import json
import shutil
import subprocess
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def mafft(source: str, options: str = "--auto", program: str = "mafft") -> list[str]:
    return [program, *options.split(), source]


def raxml_check(msa: str, model: str, prefix: str, program: str = "raxml-ng") -> list[str]:
    return [program, "--check", "--msa", msa, "--model", model, "--prefix", prefix]


def _options(**given: object) -> list[str]:
    """``--name value`` for every option that is set."""
    return [x for k, v in given.items() if v not in (None, "") for x in (f"--{k.replace('_', '-')}", str(v))]


def raxml_search(
    msa: str, model: str, prefix: str, constraint: str | None = None, starts: str = "rand{25},pars{25}", seed: int = 111, threads: int = 4, workers: int = 1,
    outgroup: str | None = None, program: str = "raxml-ng",
) -> list[str]:
    """A search from several starting trees."""
    return [program, "--search", *_options(msa=msa, model=model, tree_constraint=constraint, tree=starts, seed=seed, workers=workers, threads=threads, prefix=prefix, outgroup=outgroup)]


def raxml_bootstrap(
    msa: str, model: str, prefix: str, trees: int = 500, seed: int = 111, threads: int = 4, workers: int | None = None, constraint: str | None = None,
    outgroup: str | None = None, metric: str = "tbe", program: str = "raxml-ng",
) -> list[str]:
    """Bootstrap trees within a constraint; with a resolved tree as constraint only branch lengths vary."""
    return [program, "--bootstrap", *_options(msa=msa, model=model, tree_constraint=constraint, bs_trees=trees, bs_metric=metric, seed=seed, workers=workers, threads=threads, prefix=prefix, outgroup=outgroup)]


def raxml_support(tree: str, replicates: str, prefix: str, metric: str = "tbe", threads: int | None = None, program: str = "raxml-ng") -> list[str]:
    return [program, "--support", *_options(tree=tree, bs_trees=replicates, bs_metric=metric, threads=threads, prefix=prefix)]


def raxml_rf(trees: str, prefix: str, program: str = "raxml-ng") -> list[str]:
    return [program, "--rfdist", "--tree", trees, "--prefix", prefix]


def raxml_converged(replicates: str, prefix: str, cutoff: float = 0.03, metric: str = "tbe", seed: int = 111, threads: int = 4, program: str = "raxml-ng") -> list[str]:
    return [program, "--bsconverge", *_options(bs_trees=replicates, bs_metric=metric, bs_cutoff=f"{cutoff:g}", seed=seed, threads=threads, prefix=prefix)]


def modeltest(msa: str, partitions: str, output: str, threads: int = 4, program: str = "modeltest-ng") -> list[str]:
    return [program, "-i", msa, "-q", partitions, "-o", output, "-p", str(threads), "-t", "ml"]


def treepl(config: str, program: str = "treePL") -> list[str]:
    return [program, config]


def astral(jar: str, genes: str, output: str) -> list[str]:
    return ["java", "-jar", jar, "-i", genes, "-o", output]


def run(command: list[str], text: str | None = None, timeout: float | None = None) -> str:
    """Standard output of a command; a missing program or a failure raises with the reason."""
    if shutil.which(command[0]) is None:
        raise FileNotFoundError(f"program not found: {command[0]}")
    done = subprocess.run(command, input=text, capture_output=True, text=True, timeout=timeout, check=False)
    if done.returncode:
        raise RuntimeError(f"{command[0]} ended with {done.returncode}: {done.stderr[-2000:]}")
    return done.stdout


def align_groups(sequences: DataFrame, command: list[str]) -> DataFrame:
    """Align each marker's sequences by a program that reads FASTA from standard input.

    The program needs all sequences of a marker together, so a marker is one task's work.  A failure
    is kept in ``status`` for its marker and does not stop the others.
    """
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        try:
            out = run(command, "".join(f">{n}\n{s}\n" for n, s in zip(pdf.ord, pdf.seq, strict=True)))
        except (OSError, RuntimeError) as e:
            return pdf.assign(status=f"ERROR: {e}")
        aligned = {p.split("\n", 1)[0].strip(): "".join(p.split("\n")[1:]) for p in out.split(">") if p.strip()}
        return pdf.assign(seq=[aligned.get(str(o)) for o in pdf.ord], status="OK")

    rows = sequences.select("marker", "name", "ord", "seq")
    return rows.groupBy("marker").applyInPandas(one, "marker string, name string, ord long, seq string, status string")


def with_retries(call: Callable[[list], list], batch: list, retries: int = 5, pause: float = 0.5) -> list:
    """Call with a pause that doubles after each failure."""
    for attempt in range(retries):
        try:
            return call(batch)
        except Exception:  # noqa: BLE001  any failure of the service counts
            if attempt == retries - 1:
                raise
            time.sleep(pause * 2**attempt)
    return []


def fetch_metadata(wanted: DataFrame, cache: DataFrame, fetch: Callable[[list], list], batch: int = 200, pause: float = 0.5, retries: int = 5) -> DataFrame:
    """Metadata ``sid, species_gb, description_gb`` of wanted accessions: cached rows first, others fetched.

    ``fetch`` takes a list of accessions and returns rows; it runs in the tasks, ``batch`` at a time.
    """

    def run_batches(frames):
        import pandas as pd

        for pdf in frames:
            ids = list(pdf.sid)
            for lo in range(0, len(ids), batch):
                rows = with_retries(fetch, ids[lo : lo + batch], retries, pause)
                yield pd.DataFrame(rows, columns=["sid", "species_gb", "description_gb"])
                time.sleep(pause)

    ids = wanted.select("sid").distinct()
    new = ids.join(cache, "sid", "left_anti").mapInPandas(run_batches, "sid string, species_gb string, description_gb string")
    known = cache.select("sid", "species_gb", "description_gb").withColumn("_o", F.lit(0)).union(new.withColumn("_o", F.lit(1)))
    first = known.groupBy("sid").agg(F.min_by(F.struct("species_gb", "description_gb"), "_o").alias("r")).select("sid", "r.*")
    return first.join(ids, "sid", "left_semi")


def summary_url(ids: list[str], database: str = "nuccore") -> str:
    """The address of a public sequence archive's summaries of accessions, as JSON."""
    from urllib.parse import urlencode

    return "https://eutils.ncbi.nlm.nih.gov/entrez/eutils/esummary.fcgi?" + urlencode({"db": database, "id": ",".join(ids), "retmode": "json"})


def parse_summaries(text: str) -> list[tuple[str, str, str]]:
    """``sid, species_gb, description_gb`` of such an answer."""
    result = json.loads(text).get("result", {})
    found = [result[u] for u in result.get("uids", []) if "error" not in result[u]]
    return [(x.get("accessionversion") or x.get("caption"), x.get("organism"), x.get("title")) for x in found]


def get(url: str, headers: dict[str, str] | None = None, timeout: float = 60.0) -> str:
    from urllib.request import Request, urlopen

    with urlopen(Request(url, headers=headers or {}), timeout=timeout) as answer:  # noqa: S310  https only
        return answer.read().decode()


def fetch_summaries(ids: list[str]) -> list[tuple[str, str, str]]:
    """A fetcher for ``fetch_metadata``."""
    return parse_summaries(get(summary_url(ids)))


RED_LIST = "https://api.iucnredlist.org/api/v4"


def red_list_record(name: str, token: str, read: Callable[[str, dict], str] = get) -> str | None:
    """The nested record of a species from the public red list's API, as ``registry.flatten_records`` reads it.

    Two calls: the taxon with its assessments, and the latest of these (the first, if none is marked) in full.  A name
    of one word, or a taxon without assessments, has no record.
    """
    from urllib.parse import urlencode

    words = name.split()
    if len(words) < 2:
        return None
    headers = {"Authorization": f"Bearer {token}", "Accept": "application/json"}
    found = json.loads(read(f"{RED_LIST}/taxa/scientific_name?" + urlencode({"genus_name": words[0], "species_name": words[1]}), headers))
    listed = found.get("assessments") or []
    if not listed:
        return None
    chosen = next((a for a in listed if a.get("latest")), listed[0])
    full = json.loads(read(f"{RED_LIST}/assessment/{int(chosen['assessment_id'])}", headers))
    return json.dumps({"taxon": found.get("taxon"), "assessments": listed, "assessment": full})


def fetch_records(species: DataFrame, fetch: Callable[[str], str | None], pause: float = 1.0) -> DataFrame:
    """``species_clean, json`` of conservation records, one call for each species with a pause after it.

    A call that fails gives a null record (``registry.flatten_records`` makes it a species that was not
    found); the others go on.  Calls run in the tasks, so their number bounds the rate.
    """

    def run_all(frames):
        import pandas as pd

        for pdf in frames:
            rows = []
            for name in pdf.species_clean:
                try:
                    rows.append((name, fetch(name)))
                except Exception:  # noqa: BLE001  any failure of the service counts
                    rows.append((name, None))
                time.sleep(pause)
            yield pd.DataFrame(rows, columns=["species_clean", "json"])

    return species.select("species_clean").distinct().mapInPandas(run_all, "species_clean string, json string")


def once(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A stage table: read where it was completed before, else made and written (resume)."""
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
