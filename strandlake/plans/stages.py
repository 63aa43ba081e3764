"""The imputation chain from packed haplotypes to ALT probabilities.

A subclass gives the inputs; every costly stage is a table in the shared folder, made when it is
first asked for, so that no stage runs twice and a lost executor costs one stage at most.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame

from ..functions.tables import written
from ..operators import genmap, impute, match, select, weights

DIGITS = 10


class Stages:
    match_length = match.MIN_LENGTH
    est_ne: float = genmap.NE
    forward, backward, most = match.FORWARD, match.BACKWARD, select.BEST

    sites: DataFrame  # site, chrom, pos, ref, alt, id, original_id
    shared: DataFrame  # n, site, chrom, pos, ref, alt of typed sites
    panel_bits: DataFrame  # hap, bits
    target_bits: DataFrame
    panel_alt: DataFrame  # site, hap of ALT alleles
    genetic_map: DataFrame  # chrom, pos, cm
    n_panel: int

    @cached_property
    def n_variants(self) -> int:
        return self.sites.count()

    @cached_property
    def n_sites(self) -> int:
        return self.shared.count()

    @cached_property
    def runs(self) -> DataFrame:
        """All runs, to be looked at; nothing after it needs them."""
        return match.runs(self.panel_bits, self.target_bits, self.match_length)

    @cached_property
    def top_forward(self) -> DataFrame:
        return match.top_forward(self.panel_bits, self.target_bits, self.match_length, self.forward)

    @cached_property
    def matches(self) -> DataFrame:
        return written(match.top_backward(self.panel_bits, self.target_bits, self.match_length, self.forward, self.backward), "matches")

    @cached_property
    def cover(self) -> DataFrame:
        return written(select.coverage(self.matches, self.n_sites), "cover")

    @cached_property
    def totals(self) -> DataFrame:
        return select.totals(self.cover, self.n_panel)

    @cached_property
    def score(self) -> DataFrame:
        return written(select.scored(self.cover, self.totals), "score")

    @cached_property
    def limits(self) -> DataFrame:
        return select.thresholds(self.score, self.n_sites)

    @cached_property
    def best(self) -> DataFrame:
        return written(select.best_at_sites(self.score, self.limits, self.most), "best")

    @cached_property
    def chosen(self) -> DataFrame:
        return select.restricted(self.best.select("target_hap", "n", "ref_hap"), select.seen_again(self.best))

    @cached_property
    def wide(self) -> DataFrame:
        return written(select.expanded(self.cover, self.chosen), "wide")

    @cached_property
    def frequent(self) -> tuple[DataFrame, DataFrame]:
        return select.frequent(self.wide, self.n_sites)

    @cached_property
    def selected(self) -> DataFrame:
        return written(select.restricted(self.wide, self.frequent[0]), "selected")

    @cached_property
    def cm(self) -> DataFrame:
        return genmap.interpolated(self.genetic_map, self.shared.select("chrom", "pos", "n")).select("chrom", "n", "pos", "cm")

    @cached_property
    def rates(self) -> DataFrame:
        return genmap.recombination(self.cm, self.n_panel, self.est_ne)

    @cached_property
    def folds(self) -> DataFrame:
        """All cells of both passes, to be looked at; nothing after it needs them."""
        return written(weights.folds(self.selected, self.rates, self.frequent[1], self.n_sites), "folds")

    @cached_property
    def weights(self) -> DataFrame:
        return written(weights.pruned(self.selected, self.rates, self.frequent[1], self.n_sites), "weights")

    @cached_property
    def intervals(self) -> DataFrame:
        return impute.interval_table(impute.row_sites(self.shared, self.n_variants))

    @cached_property
    def ends(self) -> DataFrame:
        return written(impute.interval_weights(self.weights, self.intervals), "ends")

    @cached_property
    def probabilities(self) -> DataFrame:
        return written(impute.alt_probabilities(self.ends, impute.site_intervals(self.intervals), self.panel_alt, DIGITS), "probabilities")
