"""Release check: findings and repository evidence to a checklist verdict."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..dims import reference as REF
from ..functions import scoring as S
from ..session import cut_lineage
from ..operators import corpus, findings as FD, risk as RK


@dataclass(frozen=True)
class ReleaseCheck:
    findings: DataFrame
    items: DataFrame
    sections: DataFrame
    verdict: DataFrame


def release_check(
    files: DataFrame, findings: DataFrame, acceptances: DataFrame, today: str,
    probe_loaded: bool = False, symbolic_loaded: bool = False, items=REF.CHECKLIST,
) -> ReleaseCheck:
    spark = files.sparkSession
    RK.require_valid_acceptances(acceptances)
    exposure, steps = RK.exposure_table(spark), RK.chain_steps(spark)
    # Five tables are derived from the judged findings; the scan behind them runs once.
    judged = cut_lineage(RK.accept(FD.drop_fixture_paths(findings), acceptances, today), "judged")
    still = judged.filter(F.col("state") == "open")
    counts = FD.rule_counts(still)
    taken = FD.rule_counts(judged.filter(F.col("state") == "accepted"), exclude_info=False)
    chains = RK.attack_chains(still, steps, exposure)
    likely = RK.rate(still, exposure).groupBy("repo").agg(
        F.count_if(F.col("exploitability") == S.EXPLOITABILITY[-1]).alias("likely")
    )
    rows = RK.checklist(
        corpus.repo_scope(files), counts, taken, RK.repo_signals(files), chains, likely,
        items, probe_loaded, symbolic_loaded,
    )
    return ReleaseCheck(judged, rows, RK.section_worst(rows), RK.ready(rows))
