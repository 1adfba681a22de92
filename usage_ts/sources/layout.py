"""Column roles of a billing extract."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Layout:
    """Which column plays which part; the defaults are those of the utility's extracts.

    The names below are fixed values: they must match the extract headers.
    """

    account: str = "CONTRACT_ACCOUNT"
    start: str = "EFFECTIVE_DATE"
    end: str = "END_DATE"
    value: str = "CONSUMPTION"
    rate_class: str = "RATE_CLASS"
    numeric: tuple[str, ...] = (
        "PARCEL_AREA", "SSF", "REDUC_FAC", "NOM", "BILLING_AREA", "W_HEC_AF", "PREMISE_UNITS",
    )
    boolean: tuple[str, ...] = (
        "SERVICE_STATUS", "RES_LDM", "RES_MDM", "RES_HR", "S90MT", "FIRE_PROT_CHARGE_EXEMPT",
        "CUST_ASST_PROG_EXEMPT", "STORM_CHARGE_EX", "SAN_CHARGE_EX", "WATER_CHARGE_EX",
    )
    categorical: tuple[str, ...] = ("RATE_CLASS", "METER_SIZE", "INST_TYPE", "EST_READ")
    codes: tuple[str, ...] = ("EST_READ",)
    not_clustered: tuple[str, ...] = (
        "RATE_CLASS", "NOM", "REDUC_FAC", "SSF", "W_HEC_AF", "RES_LDM", "RES_MDM", "RES_HR",
    )
    # Days without data and days to cut at either end depend on the owner of the data: none by default.
    missing_ranges: tuple[tuple[str, str], ...] = ()
    start_trim: int = 0
    end_trim: int = 0
    retention_years: int = 5
    look_back_days: int = 183
    key: tuple[str, ...] = field(default=("CONTRACT_ACCOUNT", "EFFECTIVE_DATE", "END_DATE"))

    @property
    def columns(self) -> list[str]:
        return [self.account, self.start, self.end, self.value, *self.numeric, *self.boolean, *self.categorical]
