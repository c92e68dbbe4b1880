"""Labels of detectors as the entity categories of the treatment matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Labels of each category; any other label stands for a person.
CATEGORY_LABELS = {
    "Per": ("PERSON", "PER", "FULL_NAME", "FIRST_NAME", "LAST_NAME"),
    "Org": ("ORGANIZATION", "ORG", "COMPANY_NAME"),
    "OrgForm": ("ORG_FORM",),
    "OrgSector": ("ORG_SECTOR",),
    "OrgStruct": ("ORG_STRUCT",),
    "Role": ("ROLE", "JOB_TITLE"),
    "Judge": ("JUDGE", "MAGISTRATE"),
    "Lawyer": ("LAWYER",),
    "Addr": ("ADDRESS", "ADDR", "POSTAL_CODE"),
    "AddrCity": ("ADDR_CITY", "CITY", "GPE", "LOC"),
    "AddrDept": ("ADDR_DEPT", "DEPT"),
    "AddrCountry": ("ADDR_COUNTRY", "COUNTRY"),
    "DateAbs": ("DATE", "DATE_ABS", "DATE_OF_BIRTH"),
    "DateRel": ("DATE_REL",),
    "Amount": ("AMOUNT", "MONEY"),
    "AmountRange": ("AMOUNT_RANGE",),
    "Ratio": ("RATIO", "PERCENT"),
    "IdNat": ("ID_NAT", "SSN", "NIR", "NI_NUMBER", "RPPS", "NIF"),
    "IdFin": ("ID_FIN", "IBAN", "BIC", "CREDIT_CARD", "BANK_ACCOUNT"),
    "IdReg": ("ID_REG", "SIREN", "SIRET", "VAT_NUMBER", "RCS_NUMBER"),
    "IdProp": ("ID_PROP", "PATENT_NUMBER", "TRADEMARK_NUMBER"),
    "IdImmo": ("ID_IMMO", "CADASTRAL_REF"),
    "Contact": ("CONTACT", "EMAIL", "PHONE_NUMBER", "PHONE"),
    "JurisRef": ("JURIS_REF", "CASE_REFERENCE"),
    "LawRef": ("LAW_REF", "LAW_REFERENCE"),
    "ContractRef": ("CONTRACT_REF", "CONTRACT_CLAUSE", "CONTRACT_NUMBER"),
    "AssetDesc": ("ASSET_DESC", "ASSET_DESCRIPTION"),
    "Zone": ("ZONE", "REGULATORY_ZONE"),
    "Ccn": ("CCN", "COLLECTIVE_AGREEMENT"),
    "FinStruct": ("FIN_STRUCT", "FINANCIAL_DATA"),
}
LABELS = {label: category for category, names in CATEGORY_LABELS.items() for label in names}


def normalized(rows: DataFrame, label: str) -> DataFrame:
    """The rows with ``category``, by a join with the fixed table of labels."""
    known = rows.sparkSession.createDataFrame(list(LABELS.items()), "__raw string, category string")
    return rows.join(F.broadcast(known), F.upper(label) == F.col("__raw"), "left").withColumn("category", F.coalesce("category", F.lit("Per"))).drop("__raw")
