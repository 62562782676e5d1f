"""From base tables to the eligible, index and scored tables.

``CohortBuild`` is the table plan: every property is one table, computed from the
ones before it and written once to the shared folder, because several later
tables and reports read it.  Pure functions live in ``operators``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..operators import eligibility, index_visit, phenotypes, risk
from ..operators.results import watched_results
from ..schemas import BASE_TABLES
from ..sources.extracts import create_table
from ..storage import written


PCE_TABLE = "pce_first_eligible_encounter_with_predictors"
ASCVD_TABLE = "prevents_first_ascvd_eligible_encounter_with_predictors"
TOTAL_CVD_TABLE = "prevents_first_total_cvd_eligible_encounter_with_predictors"


class CohortBuild:
    """All derived tables over one set of base tables.

    Two definitions of the published cohort differ from what their names suggest
    and are kept by default: the 30-day supply rule reaches one drug class only
    (``all_classes_checked`` applies it to all), and ASCVD deaths from the death
    index are no total-CVD outcomes (``count_ascvd_deaths`` makes them so).
    """

    def __init__(
        self,
        tables: dict[str, DataFrame],
        all_classes_checked: bool = False,
        count_ascvd_deaths: bool = False,
    ):
        self.base = tables
        self.all_classes_checked = all_classes_checked
        self.count_ascvd_deaths = count_ascvd_deaths

    @classmethod
    def over_written_base(cls, tables: dict[str, DataFrame], **options) -> CohortBuild:
        """Write the base tables first.

        Laboratory rows are ordered by component inside each file (no shuffle), so
        the component filters skip row groups.
        """
        out = {}
        for name, df in tables.items():
            ordered = df.sortWithinPartitions("component_id") if name == "labs" else df
            out[name] = written(ordered, name)
        return cls(out, **options)

    @cached_property
    def measured(self) -> dict[str, DataFrame]:
        """Base tables with laboratory results scanned and cleaned once, for the three tables made of them."""
        results = watched_results(self.base["labs"]).sortWithinPartitions("component_id")
        return {**self.base, "labs": written(results, "results")}

    @cached_property
    def profile(self) -> DataFrame:
        return written(
            phenotypes.patient_profile(self.measured, self.count_ascvd_deaths), "profile"
        )

    @cached_property
    def screened(self) -> DataFrame:
        """Visit days both outcomes choose their index visits from."""
        timeline = index_visit.visit_timeline(self.measured)
        return written(index_visit.screened_days(timeline, self.profile), "screened")

    def eligible(self, outcome: str, expand: bool = False) -> DataFrame:
        """``ascvd_eligible_encounters`` / ``total_cvd_eligible_encounters``.

        Equal rows are one row with their number in ``published_rows``, or repeated with ``expand``.
        """
        return eligibility.eligible_encounters(self.base, self.profile, outcome, expand=expand)

    def candidates(self, outcome: str) -> DataFrame:
        """Visit days on which an index visit could fall."""
        return index_visit.candidate_days(self.screened, outcome)

    def _index(self, outcome: str) -> DataFrame:
        visits = written(index_visit.first_visits(self.candidates(outcome)), f"{outcome}_visits")
        complete = index_visit.complete_index(
            visits, self.base["medications"], outcome, self.all_classes_checked
        )
        return written(complete, f"{outcome}_index")

    @cached_property
    def _ascvd_index(self) -> DataFrame:
        return self._index("ascvd")

    @cached_property
    def _total_cvd_index(self) -> DataFrame:
        return self._index("total_cvd")

    @property
    def pce_index(self) -> DataFrame:
        """``pce_first_eligible_encounter_with_predictors``."""
        return index_visit.without_egfr(self._ascvd_index)

    @property
    def prevent_ascvd_index(self) -> DataFrame:
        """``prevents_first_ascvd_eligible_encounter_with_predictors``."""
        return index_visit.with_egfr(self._ascvd_index)

    @property
    def prevent_total_cvd_index(self) -> DataFrame:
        """``prevents_first_total_cvd_eligible_encounter_with_predictors``."""
        return index_visit.with_egfr(self._total_cvd_index)

    @cached_property
    def pce(self) -> DataFrame:
        """PCE analysis set with risks."""
        people = index_visit.analysis_set(self.pce_index, by_race=True)
        return written(risk.pce_risks(people), "pce")

    @cached_property
    def prevent_ascvd(self) -> DataFrame:
        people = index_visit.analysis_set(self.prevent_ascvd_index)
        return written(risk.prevent_ascvd_risks(people), "prevent_ascvd")

    @cached_property
    def prevent_total_cvd(self) -> DataFrame:
        people = index_visit.analysis_set(self.prevent_total_cvd_index)
        return written(risk.prevent_total_cvd_risks(people), "prevent_total_cvd")

    def published_tables(self, expand: bool = False) -> dict[str, DataFrame]:
        """Base and derived tables under the names later analyses select from."""
        return {
            **self.base,
            "ascvd_eligible_encounters": self.eligible("ascvd", expand),
            "total_cvd_eligible_encounters": self.eligible("total_cvd", expand),
            PCE_TABLE: self.pce_index,
            ASCVD_TABLE: self.prevent_ascvd_index,
            TOTAL_CVD_TABLE: self.prevent_total_cvd_index,
        }

    def create_tables(self, folder: str | None = None, expand: bool = False, buckets: int | None = None) -> None:
        """Create every published table in the catalog; existing ones are an error.

        With ``buckets``, tables with a patient id are clustered by it, so that joins per
        patient between them need no exchange.
        """
        for name, df in self.published_tables(expand).items():
            create_table(df, name, folder, "pat_id" if "pat_id" in df.columns else None, buckets)


class PublishedCohort(CohortBuild):
    """The cohort of an earlier session, read from the tables it created."""

    def __init__(self, spark: SparkSession):
        super().__init__({name: spark.table(name) for name in BASE_TABLES})
        self._spark = spark

    def eligible(self, outcome: str, expand: bool = False) -> DataFrame:
        """The created table as it is, with repeated rows or with their number."""
        return self._spark.table(f"{outcome}_eligible_encounters")

    @property
    def pce_index(self) -> DataFrame:
        return self._spark.table(PCE_TABLE)

    @property
    def prevent_ascvd_index(self) -> DataFrame:
        return self._spark.table(ASCVD_TABLE)

    @property
    def prevent_total_cvd_index(self) -> DataFrame:
        return self._spark.table(TOTAL_CVD_TABLE)
