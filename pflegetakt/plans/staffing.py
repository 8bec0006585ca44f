"""The whole dataflow, one lazy table per stage."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pflegetakt.operators.lookups import control_row, control_scalars
from pflegetakt.operators.skew import HotCases, hot_cases
from pflegetakt.plans import patient_days, reports, totals, ward_days, workload
from pflegetakt.schemas import check_columns
from pflegetakt.settings import Settings


@dataclass(frozen=True)
class Inputs:
    """Input tables; ``night`` is only needed by the older night rules.

    ======================  ====================================================
    ``stays``               pid, case_id, ward, begin_ts, end_ts, ord
    ``classifications``     category, code, pid, datum, ord
    ``controls``            kategorie, wert
    ``wards``               ward, kategorie, betten, ausfall1..3, nachtdienst_quote
    ``newborns``            case_id, birth, discharge
    ``night``               patienten, min_ex_net, min_hilf_net, min_ex_geb_net
    ======================  ====================================================

    ``ord`` is the row order of the source: unique, never null, comparable.
    """

    stays: DataFrame
    classifications: DataFrame
    controls: DataFrame
    wards: DataFrame
    newborns: DataFrame
    night: DataFrame | None = None

    def __post_init__(self):
        check_columns(self)


class Staffing:
    """Stages of one run.

    All are lazy; only ``imputed`` and the row tables behind it count the wards once while they are
    built, because the means are then joined to every row. Ward-days and reports do not use them.
    """

    def __init__(self, inputs: Inputs, settings: Settings | None = None):
        self.inputs = inputs
        self.settings = settings or Settings()

    # Patient-days

    @cached_property
    def valid_stays(self) -> DataFrame:
        return patient_days.valid_stays(self.inputs.stays, self.settings)

    @cached_property
    def hot(self) -> HotCases:
        return hot_cases(self.valid_stays, self.settings)

    @cached_property
    def master_days(self) -> DataFrame:
        return patient_days.master_days(self.valid_stays)

    @cached_property
    def classified_days(self) -> DataFrame:
        return patient_days.classified_days(
            patient_days.last_classifications(self.inputs.classifications, self.settings)
        )

    @cached_property
    def attached(self) -> DataFrame:
        return patient_days.attach_classifications(self.master_days, self.classified_days)

    @cached_property
    def filled(self) -> DataFrame:
        return patient_days.fill_categories(self.attached, self.hot)

    @cached_property
    def rated(self) -> DataFrame:
        return patient_days.rate_days(
            self.filled, self.inputs.controls, self.control_row, self.control
        )

    @cached_property
    def imputed(self) -> DataFrame:
        wards = patient_days.count_wards(self.valid_stays)
        return patient_days.impute_ward_mean(self.rated, wards, self.settings)

    # Workload

    @cached_property
    def control_row(self) -> Column:
        return control_row(self.inputs.controls, self.settings.live_keys).scalar()

    @property
    def control(self) -> dict[str, Column]:
        """Control values in rows that ``rate_days`` has given them."""
        return {short: F.col("control")[short] for short in self.settings.live_keys}

    @cached_property
    def weighted(self) -> DataFrame:
        return workload.weigh_days(self.imputed, self.control)

    @cached_property
    def newborn_spans(self) -> DataFrame:
        return workload.newborn_spans(self.inputs.newborns)

    @cached_property
    def all_days(self) -> DataFrame:
        return workload.replace_newborns(self.weighted, self.newborn_spans, self.hot, self.settings)

    # Ward-days and reports

    @cached_property
    def master(self) -> DataFrame:
        return ward_days.ward_master(self.inputs.wards, self.settings)

    @cached_property
    def ward_totals(self) -> DataFrame:
        """The same as ``ward_days.ward_totals`` of ``all_days``, from one pass over the patient-days."""
        marked = workload.mark_newborns(self.rated, self.newborn_spans, self.hot)
        sums = totals.with_means(totals.ward_sums(marked, self.control, "imputed"))
        newborns = workload.newborn_days(self.newborn_spans, self.settings)
        return totals.ward_totals(sums, newborns, self.settings)

    @cached_property
    def ward_days(self) -> DataFrame:
        return ward_days.with_quota_nights(self.ward_totals, self.master, self.settings)

    def monthly_shifts(self, days: DataFrame | None = None) -> DataFrame:
        return reports.monthly_shifts(self.ward_days if days is None else days, self.settings)

    def monthly_report(self, days: DataFrame | None = None) -> DataFrame:
        """Reports take stored ward-days in place of computing them again; unordered."""
        return reports.monthly_report(self.monthly_shifts(days), self.master, self.settings)

    def in_report_order(self, report: DataFrame) -> DataFrame:
        return reports.in_report_order(report, self.settings)

    def ward_month_total(
        self, days: DataFrame | None = None, report: DataFrame | None = None
    ) -> DataFrame:
        """Of a stored monthly report, if one is given."""
        report = self.monthly_report(days) if report is None else report
        return reports.ward_month_total(report, self.settings)

    def missing_report(self, days: DataFrame | None = None) -> DataFrame:
        return reports.missing_report(self.ward_days if days is None else days, self.settings)

    # Checks of the inputs

    def stay_checks(self) -> DataFrame:
        return patient_days.stay_checks(self.inputs.stays, self.settings)

    def rejected_stays(self) -> DataFrame:
        return patient_days.with_ids(
            patient_days.rejected_stays(self.inputs.stays, self.settings)
        )

    def long_stays(self) -> DataFrame:
        return patient_days.with_ids(patient_days.long_stays(self.inputs.stays, self.settings))

    def newborn_checks(self) -> DataFrame:
        return workload.newborn_checks(self.inputs.newborns)

    def rejected_newborns(self) -> DataFrame:
        return workload.rejected_newborns(self.inputs.newborns)

    def split_wards(self) -> DataFrame:
        """Merged wards that multiply their ward-days."""
        return ward_days.split_wards(self.master)

    # Older rules: no newborns, flag after filling, other weighting, night lookup

    @cached_property
    def weighted_older(self) -> DataFrame:
        days = self.imputed.drop("imputed").withColumnRenamed("imputed_after_fill", "imputed")
        return workload.weigh_days_older(days, self.control)

    @cached_property
    def ward_totals_older(self) -> DataFrame:
        """The same as ``ward_days.ward_totals`` of ``weighted_older``."""
        sums = totals.ward_sums(self.rated, self.control, "imputed_after_fill", older=True)
        sums = totals.with_means(sums, older=True)
        return totals.ward_totals(sums, None, self.settings)

    def _night(self) -> DataFrame:
        if self.inputs.night is None:
            raise ValueError("the night lookup table is missing")
        return self.inputs.night

    def night_lookup(self, obstetric_wards=None) -> DataFrame:
        """Ward-days of the current weighting with night minutes from the table."""
        master = ward_days.ward_master(self.inputs.wards, self.settings, with_quota=False)
        return ward_days.with_lookup_nights(
            self.ward_totals, self._night(), master, self.settings, obstetric_wards
        )

    def vk_by_qualification(self, obstetric_wards=None) -> DataFrame:
        control = control_scalars(self.inputs.controls, self.settings.older_keys)
        days = ward_days.with_qualification(
            self.ward_totals_older,
            self._night(),
            control["helper_share"],
            self.settings,
            obstetric_wards,
        )
        return reports.vk_by_qualification(days, control["absence"], self.settings)
