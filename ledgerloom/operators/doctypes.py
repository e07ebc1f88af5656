"""Document types by file name."""

from __future__ import annotations

from pyspark.sql import Column

from .rules import inferred_type

#: What a file name contains, and the type it stands for; the first pair that fits counts.
FILENAME_TYPES = [
    (("legal opinion", "opinion"), "legal_opinion"),
    (("registry deed", "registered deed"), "registry_deed"),
    (("certified copy", "certifiedcopy"), "certified_copy"),
    (("ro d", "rod output", "rod verification"), "rod_output"),
    (("estamp", "e-stamp", "e stamp", "stamp certificate"), "estamp_certificate"),
    (("stamp challan", "challan"), "stamp_challan"),
    (("stamp receipt",), "stamp_receipt"),
    (("fard", "fard e malkiat", "fard-e-malkiat", "fardmalkiat"), "fard"),
    (("jamabandi",), "jamabandi"),
    (("mutation", "mutation entry", "intiqal"), "mutation_entry"),
    (("society allotment", "allotment letter"), "society_allotment"),
    (("society transfer", "transfer letter"), "society_transfer"),
    (("society membership", "membership"), "society_membership"),
    (("society mortgage permission", "mortgage permission"), "society_mortgage_permission"),
    (("society ndc", "society noc"), "society_ndc"),
    (("lda layout plan", "layout plan", "approved layout"), "lda_layout_plan"),
    (("lda noc", "lda approval"), "lda_noc"),
    (("placement letter", "placement"), "placement_letter"),
    (("one window receipt", "one window"), "one_window_receipt"),
    (("commercialization letter", "commercialization"), "commercialization_letter"),
    (("ruda noc", "ruda approval"), "ruda_noc"),
    (("ruda notification",), "ruda_notification"),
    (("cantonment noc", "cantonment approval"), "cantonment_noc"),
    (("lease deed", "lease"), "lease_deed"),
    (("grant conditions", "grant"), "grant_conditions"),
    (("municipal dues clearance", "dues clearance"), "municipal_dues_clearance"),
    (("pt-1", "pt1", "property tax pt1"), "pt1"),
    (("property tax receipt", "tax receipt"), "property_tax_receipt"),
    (("possession affidavit", "possession"), "possession_affidavit"),
    (("rent agreement", "rental"), "rent_agreement"),
    (("tenant noc", "tenant no objection"), "tenant_noc"),
    (("site visit memo", "site visit", "inspection memo"), "site_visit_memo"),
    (("dha intimation", "intimation"), "dha_intimation_letter"),
    (("dha consent", "consent"), "seller_consent_letter"),
    (("ndc", "dha ndc"), "dha_ndc"),
    (("site plan", "siteplan"), "site_plan"),
    (("approved drawing", "approved map", "approvedmap", "map"), "approved_map"),
    (("completion certificate", "completion"), "completion_certificate"),
    (("registry", "registered", "sale deed"), "registry_instrument"),
    (("cnic", "nic", "id card"), "CNIC Copy"),
    (("photo", "photograph", "passport"), "Photograph"),
    (("salary", "payslip", "pay slip"), "Salary Slip"),
    (("bank statement", "statement"), "Bank Statement"),
    (("utility", "electricity", "gas bill", "water bill"), "Utility Bill"),
    (("noc", "no objection"), "Society NOC"),
    (("allotment", "allocation"), "Allotment Letter"),
    (("possession", "handover"), "Possession Letter"),
    (("site", "verification", "inspection"), "Site Report"),
    (("resolution", "board"), "Board Resolution"),
    (("poa", "power of attorney"), "Power of Attorney"),
    (("plan", "layout", "building plan"), "Building Plan"),
]


def type_of(filename: Column) -> Column:
    """The type of the first pair with a pattern in the name, or null."""
    return inferred_type(filename, FILENAME_TYPES)
