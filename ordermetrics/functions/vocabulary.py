"""Label and code values the classifications use.

Values below equal the source system's (fixed values). Codes that contain the
operating company's or a brand's name are settings of :class:`Vocabulary`.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: order states -------------------------------------------
CANCELLED_STATES = ["CANCELLED", "CANCELLED_BY_PATIENT"]
RETURNED_STATES = ["RECEIVED", "RELEASED", "RECOLLECTED"]
PENDING_STATES = [
    "PATIENT_PENDING_VALID_INSURANCE",
    "PENDING_ELIGIBILITY_CHECK",
    "PENDING_PATIENT_INFO",
    "PENDING_MANUAL_ELIGIBILITY_CHECK",
    "WAITING_FOR_PAYMENT",
]
OPEN_STATES = ["APPROVED", "CREATED"]
# --- fixed values: order flows --------------------------------------------
TRANSCRIBED_FLOWS = ["trf_transcribed", "doctor_transcribed"]
DOCTOR_FLOWS = ["trf_transcribed", "doctor_transcribed", "emr_trascribed", "reflex_orders"]
PATIENT_FLOWS = ["patient_doctor_none", "patient_doctor_selected", "prescripted_orders"]
UNINSURED_FLOWS = ["free_of_approval"]
# --- fixed values: sample process results ---------------------------------
PROCESS_SUCCESS = ["success"]
PROCESS_FAILURES = ["recollected", "recollection", "final-rejected"]
# --- fixed values: programs, claims, appeals ------------------------------
PROGRAM_LABELS = {
    "pap": "1. pap",
    "cash_pay_program": "2. cash_pay_program",
    "patient_responsibility": "3. patient_responsibility",
}
OTHER_PROGRAMS = "4. legacy_or_misc_programs"
DENIAL_MESSAGE = "CLAIM DENIED BY PAYER"
DEFAULT_APPEAL = "medical_necessity"
FIRST_APPEAL = "first_appeal"
UNINFORMATIVE_ISSUE = "N"
# --- fixed values: turnaround bands (days, inclusive upper bounds) ---------
TURNAROUND_BANDS = [("Up to 7 days", 7), ("8 - 14 days", 14), ("15 days or more", None)]
# --- fixed values: utm ----------------------------------------------------
UTM_START = "2018-09-20"
PERFORMANCE, BRAND = "Online Performance Marketing", "Brand Marketing"


@dataclass(frozen=True)
class Vocabulary:
    """Deployment-specific names inside codes and texts. A wrong name mislabels silently, so none has a default."""

    company: str
    starter_brand: str
    brands: tuple[str, ...]
    upgrade_prefixes: tuple[str, ...]
    upgrade_versions: tuple[int, ...] = (1, 2, 3)
    utm_start: str = UTM_START

    @property
    def rejected_states(self) -> list[str]:
        return ["REJECTED", f"REJECTED_BY_{self.company.upper()}"]

    @property
    def patient_flows(self) -> list[str]:
        return [f"patient_doctor_{self.company.lower()}", *PATIENT_FLOWS]

    @property
    def closed_report_states(self) -> list[str]:
        return ["RELEASED", *CANCELLED_STATES, self.rejected_states[1], "RECOLLECTED"]

    @property
    def excluded_recent_states(self) -> list[str]:
        return ["DRAFT", "PENDING_PATIENT_INFO", self.rejected_states[1]]

    @property
    def upgrade_phrases(self) -> list[str]:
        return ["upgraded from", f"{self.starter_brand.lower()} upgrade"]

    @property
    def upgrade_labels(self) -> list[str]:
        starter = f"{self.starter_brand.capitalize()} Upgrade"
        versions = [f"Upgraded from {p}v{n}" for n in self.upgrade_versions for p in self.upgrade_prefixes]
        return [starter, *versions]
