"""Dimension data: identifier types, label order and crosswalks. Small by construction, so joins on it are broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: type: (Safe Harbor row, weight, direct?)
TYPES = {
    "ACCOUNT_NUMBER": (10, 20, True),
    "ADDRESS": (2, 20, True),
    "BANK_ROUTING": (10, 10, True),
    "BIOMETRIC_ID": (16, 25, True),
    "CREDIT_CARD": (10, 30, True),
    "DATE_DOB": (3, 15, False),
    "DATE_TIME": (3, 5, False),
    "DEVICE_ID": (13, 10, False),
    "EMAIL": (6, 10, True),
    "FAX_NUMBER": (5, 10, True),
    "GEO_COORDINATE": (2, 20, False),
    "HEALTH_PLAN_ID": (9, 30, True),
    "IP_ADDRESS": (15, 5, False),
    "MAC_ADDRESS": (18, 10, False),
    "MRN": (8, 30, True),
    "NATIONAL_ID": (18, 30, True),
    "PERSON_NAME": (1, 15, True),
    "PHONE_US": (4, 10, True),
    "SSN": (7, 30, True),
    "SWIFT_BIC": (10, 5, False),
    "TAX_ID": (18, 20, True),
    "URL": (14, 5, False),
    "USER_ID": (18, 10, True),
    "US_DRIVER_LICENSE": (11, 20, True),
    "VEHICLE_ID": (12, 15, True),
}
PHI_SPECIFIC = frozenset({"MRN", "HEALTH_PLAN_ID"})
CHECKSUMMED = frozenset("BANK_ROUTING CREDIT_CARD EMAIL IP_ADDRESS MAC_ADDRESS SSN SWIFT_BIC TAX_ID URL VEHICLE_ID".split())
MODEL_ONLY = frozenset("BIOMETRIC_ID DATE_TIME DEVICE_ID GEO_COORDINATE NATIONAL_ID USER_ID".split())
LABELS = ("NONE", "PII", "PHI")

#: Combinations of quasi-identifiers that single a person out: members and bonus, strongest first.
COMBOS = (
    (("PERSON_NAME", "DATE_DOB", "ADDRESS"), 20),
    (("PERSON_NAME", "DATE_DOB"), 12),
    (("PERSON_NAME", "ADDRESS"), 12),
    (("DATE_DOB", "ADDRESS"), 12),
    (("DATE_DOB", "PHONE_US"), 8),
)

def _tags(lines: str) -> dict[str, tuple[str, ...]]:
    """TYPE=name,name ... after a vertical."""
    out: dict[str, tuple[str, ...]] = {}
    for line in lines.strip().splitlines():
        vertical, *pairs = line.split()
        for pair in pairs:
            kind, names = pair.split("=")
            out[kind] = tuple(f"sensitive_{vertical}_{n}" for n in names.split(","))
    return out


#: Identifier type to its document tags; an IP address is told apart by its text.
TAGS = _tags("""
pii ADDRESS=address,street_number_and_name DATE_DOB=date_of_birth_dob EMAIL=email GEO_COORDINATE=geolocation MAC_ADDRESS=mac_address PERSON_NAME=full_name PHONE_US=phone_number SSN=social_security_number
pii US_DRIVER_LICENSE=driver_s_license_number USER_ID=username VEHICLE_ID=vehicle_identification_number_vin
pci ACCOUNT_NUMBER=bank_account_number BANK_ROUTING=routing_number CREDIT_CARD=credit_card,credit_card_number SWIFT_BIC=swift_code TAX_ID=individual_taxpayer_identification_number_itin
phi HEALTH_PLAN_ID=health_plan_beneficiary_number MRN=medical_record_number_mrn
""")


def _coarse(lines: str) -> dict[str, str]:
    """tag: the coarse names that stand for it."""
    pairs = (line.split(": ") for line in lines.strip().splitlines())
    return {name: f"sensitive_{tag}" for tag, names in pairs for name in names.split("; ")}


#: Coarse entity names of positive-only sources to document tags.
COARSE = _coarse("""
pci_bank_account_number: bank account; bank account number
pci_credit_card_number: credit card; credit card number
pci_iban: iban
pci_individual_taxpayer_identification_number_itin: itin; taxpayer identification number
phi_health_plan_beneficiary_number: health plan beneficiary number
phi_medical_record_number_mrn: medical record number; mrn
phi_patient_id_number: patient id
pii_address: address
pii_driver_s_license_number: driver license; drivers license; driver's license
pii_email: email; email address
pii_full_name: full name
pii_military_identification_number: military id
pii_passport_number: passport; passport number
pii_password: password
pii_personal_identification_number_pin: pin
pii_phone_number: phone; phone number
pii_social_security_number: social security number; ssn
pii_state: state
pii_street_number_and_name: street address
pii_visa_number: visa; visa number
pii_zip_code: zip; zip code
""")


def types_table(spark: SparkSession) -> DataFrame:
    rows = [(t, h, w, d, t in PHI_SPECIFIC, t in CHECKSUMMED, t in MODEL_ONLY) for t, (h, w, d) in sorted(TYPES.items())]
    return spark.createDataFrame(rows, "type string, hipaa int, weight int, direct boolean, phi_specific boolean, checksummed boolean, model_only boolean")
