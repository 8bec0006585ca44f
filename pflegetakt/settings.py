"""Parameters of the staffing rules.

The defaults are fixed values: results only agree with the rules in force when
they are kept. Every one of them can be replaced per run.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    # Classification codes.
    category_pattern: str = "^A[0-9]"
    isolation_code: str = "A5_ISO"

    # Keys of the control table.
    base_key: str = "Pflegegrundwert"
    raised_base_key: str = "erhöhter Pflegegrundwert"
    admission_key: str = "Aufnahme"
    discharge_key: str = "Entlassung"
    absence_key: str = "Ausfallzeiten"
    helper_share_key: str = "Anteil_Hilf"

    # Stays and wards.
    admitted_from: dt.date | None = dt.date(2024, 1, 1)
    require_ward: bool = True
    ward_merge: Mapping[str, str] = field(
        default_factory=lambda: {"CH1": "CH13", "CH3": "CH13", "IM1": "IM12", "IM2": "IM12"}
    )

    # Newborns.
    newborn_ward: str = "GB2"
    newborn_minutes: float = 110.0
    newborn_code: str = "Ges_Neugeb"

    # Working time.
    weekly_hours: float = 38.5
    night_hours: float = 8.0
    lead_ratio: float = 50.0

    # Labels of the monthly report.
    site: str = "Marienstift"
    department_key: str = "noch_fuellen"
    department_name: str = "noch_fuellen"
    day_label: str = "Tag"
    night_label: str = "Nacht"

    # Stays of more days are reported; they count unless the second is off.
    long_stay_days: int = 3650
    count_long_stays: bool = True

    # Two texts of one day count as two classifications unless this is off.
    dedupe_by_text: bool = True

    # Months of different years share a row unless this is set.
    by_year: bool = False

    # Size limits that choose a physical strategy; results do not depend on them.
    max_case_days: int = 1_000_000
    max_broadcast_wards: int = 100_000

    @property
    def minutes_per_day(self) -> float:
        """Working minutes of one full-time post per calendar day."""
        return self.weekly_hours / 7 * 60

    @property
    def minutes_per_month(self) -> float:
        """Working minutes of one full-time post per average month."""
        return self.weekly_hours * (365 / 12 / 7) * 60

    @property
    def night_minutes(self) -> float:
        return 60 * self.night_hours

    @property
    def live_keys(self) -> dict[str, str]:
        """Control rows the current rules need, by short name."""
        return {
            "base": self.base_key,
            "raised_base": self.raised_base_key,
            "admission": self.admission_key,
            "discharge": self.discharge_key,
            "absence": self.absence_key,
        }

    @property
    def older_keys(self) -> dict[str, str]:
        """Control rows the qualification split needs on top."""
        return {**self.live_keys, "helper_share": self.helper_share_key}
