"""The controlled vocabulary: domains, categories of each domain, doctypes, and aliases of all three.

Vocabularies are registered by name.  A lookup goes by the normalised term: canonical terms first, then aliases; an
alias's target is taken as it is.  As tables a vocabulary is three small dimensions of (raw, canonical) rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# The terms of the household vocabulary.
DOMAINS = "career education financial food government household housing insurance legal lifestyle medical personal pets property reference utilities"
CATEGORIES = """
financial: banking credit investment loan payment retirement tax
property: expense hoa improvement maintenance mortgage payment rental search
medical: claim expense immunization lab_result mental_health payment prescription primary_care specialist vision
legal: court estate
education: certification expense financial_aid payment transcript
insurance: auto claim health home life payment umbrella
personal: expense identity membership travel
government: federal local state
utilities: electric expense gas internet payment phone trash water
career: application benefit client compensation consulting documentation employer expense job_search leadership meeting presentation review training
food: meal_plan
household: documentation expense goods network insurance loans maintenance purchase registration vehicle
lifestyle: expense goal interest planning travel volunteering
pets: expense medical registration
reference: documentation topic
housing: payment property rental search
"""
DOCTYPES = """
agreements applications bills certificates confirmations deeds estimates floor_plans forms guides identifications invoices
itineraries journals leases letters licenses listings manuals maps menus notices offers passports paystubs permits plans
policies portfolios presentations quotes receipts recipes records references referrals reports reservations resumes returns
statements titles trusts warranties wills
"""
# Aliases and what they stand for.
DOMAIN_ALIASES = {
    "apartment": "housing",
    "lease": "housing",
    "real_estate": "housing",
    "realestate": "housing",
    "rental": "housing",
    "rentals": "housing",
    "attorney": "legal",
    "law": "legal",
    "lawyer": "legal",
    "auto": "household",
    "automobile": "household",
    "car": "household",
    "truck": "household",
    "vehicle": "household",
    "vehicles": "household",
    "banking": "financial",
    "finance": "financial",
    "finances": "financial",
    "money": "financial",
    "bills": "utilities",
    "college": "education",
    "school": "education",
    "university": "education",
    "doctor": "medical",
    "health": "medical",
    "healthcare": "medical",
    "hospital": "medical",
    "federal": "government",
    "gov": "government",
    "govt": "government",
    "state": "government",
    "home": "property",
    "house": "property",
    "job": "career",
    "work": "career",
    "travel": "lifestyle",
    "non_profit": "personal",
    "nonprofit": "personal",
}
CATEGORY_ALIASES = {
    "career": {
        "interviewing": "job_search",
        "resume": "job_search",
        "docs": "documentation",
        "receipts": "expense",
        "purchases": "expense",
        "spending": "expense",
        "purchase": "expense",
        "billing": "compensation",
    },
    "reference": {
        "manual": "documentation",
    },
    "property": {
        "agreement": "mortgage",
        "home_improvement": "improvement",
        "home_improvements": "improvement",
        "repairs": "maintenance",
        "home_repairs": "maintenance",
        "termination_of_service": "maintenance",
        "association": "hoa",
        "condo": "hoa",
        "lease": "rental",
        "housing": "rental",
        "receipts": "expense",
        "purchases": "expense",
        "spending": "expense",
        "purchase": "expense",
    },
    "housing": {
        "agreement": "rental",
        "apartment": "rental",
        "lease": "rental",
        "real_estate": "property",
        "mortgage": "property",
        "home": "property",
    },
    "personal": {
        "goals": "identity",
        "annual_report": "membership",
        "purchase": "expense",
        "traveling": "travel",
    },
    "financial": {
        "bank": "banking",
        "checking": "banking",
        "savings": "banking",
        "account": "banking",
        "account_information": "banking",
        "account_statement": "banking",
        "accounting": "banking",
        "statement": "banking",
        "transaction": "banking",
        "transfer": "banking",
        "transfer_money": "banking",
        "correspondence": "banking",
        "credit_card": "credit",
        "credit_cards": "credit",
        "cards": "credit",
        "credit_card_statement": "credit",
        "stocks": "investment",
        "bonds": "investment",
        "brokerage": "investment",
        "equities": "investment",
        "401k": "retirement",
        "ira": "retirement",
        "pension": "retirement",
        "distribution": "retirement",
        "taxes": "tax",
        "irs": "tax",
        "loan_documents": "loan",
        "payment_services": "payment",
        "billing": "payment",
        "compensation": "payment",
    },
    "medical": {
        "bills": "expense",
        "claims": "claim",
        "rx": "prescription",
        "medications": "prescription",
        "labs": "lab_result",
        "tests": "lab_result",
        "annual_examination": "primary_care",
        "exam": "primary_care",
        "visit": "primary_care",
        "behavior_modification": "mental_health",
        "billing": "payment",
    },
    "insurance": {
        "car": "auto",
        "vehicle": "auto",
        "homeowners": "home",
        "property": "home",
        "medical": "health",
        "billing": "payment",
    },
    "lifestyle": {
        "trip": "travel",
        "vacation": "travel",
        "trips": "travel",
        "trip_itinerary": "travel",
        "traveling": "travel",
        "travel_planning": "planning",
        "career": "planning",
        "job_search": "planning",
        "receipts": "expense",
        "purchases": "expense",
        "spending": "expense",
        "purchase": "expense",
        "gift_giving": "expense",
        "training": "interest",
        "volunteer_programming": "volunteering",
    },
    "pets": {
        "receipts": "expense",
        "purchases": "expense",
        "spending": "expense",
    },
    "household": {
        "receipts": "expense",
        "purchases": "expense",
        "spending": "expense",
        "vehicle_registration_renewal": "registration",
        "vehicle_related_policies": "insurance",
        "vehicle_service_records": "vehicle",
    },
    "education": {
        "receipts": "expense",
        "purchases": "expense",
        "spending": "expense",
        "tuition": "expense",
    },
    "food": {
        "purchase": "expense",
    },
}
#: Beside these, every doctype's singular is its alias.
DOCTYPE_ALIASES = {
    "boat_reservation": "reservations",
    "bus_reservation": "reservations",
    "event_reservation": "reservations",
    "flight_reservation": "reservations",
    "food_establishment_reservation": "reservations",
    "lodging_reservation": "reservations",
    "rental_car_reservation": "reservations",
    "reservation_package": "reservations",
    "taxi_reservation": "reservations",
    "train_reservation": "reservations",
    "ticket": "reservations",
    "tickets": "reservations",
    "order": "receipts",
    "pay_bill": "receipts",
    "payment": "receipts",
    "payment_receipt": "receipts",
    "purchase": "receipts",
    "transaction": "receipts",
    "contract": "agreements",
    "contracts": "agreements",
    "service_agreement": "agreements",
    "mortgage": "agreements",
    "bank_statement": "statements",
    "account_statement": "statements",
    "monthly_statement": "statements",
    "closing_docs": "statements",
    "settlement_statement": "statements",
    "hud1": "statements",
    "hoa_dues": "statements",
    "hoa_bill": "statements",
    "billing_statement": "statements",
    "medical_billing_statement": "statements",
    "correspondence": "letters",
    "mail": "letters",
    "notification": "notices",
    "alert": "notices",
    "reminder": "notices",
    "request_for_termination_of_service": "notices",
    "document": "forms",
    "paperwork": "forms",
    "w2": "forms",
    "w-2": "forms",
    "1099": "forms",
    "insurance_policy": "policies",
    "coverage": "policies",
    "insurance": "policies",
    "cert": "certificates",
    "certification": "certificates",
    "credential": "certificates",
    "assessment": "reports",
    "summary": "reports",
    "analysis": "reports",
    "patient_care_summary": "reports",
    "discharge_summary": "reports",
    "history": "records",
    "log": "records",
    "shot_record": "records",
    "call_notes": "records",
    "service_record": "records",
    "proposal": "estimates",
    "bid": "quotes",
    "owner_manual": "manuals",
    "instructions": "guides",
    "how_to": "guides",
    "1040": "returns",
    "property_deed": "deeds",
    "car_title": "titles",
    "vehicle_title": "titles",
    "drivers_license": "licenses",
    "registration": "licenses",
    "cookbook": "recipes",
    "cv": "resumes",
    "travel_plan": "itineraries",
    "pay_stub": "paystubs",
    "paycheck": "paystubs",
    "earnings_statement": "paystubs",
    "rental_agreement": "leases",
    "apartment_lease": "leases",
    "rental_lease": "leases",
    "lease_agreement": "leases",
    "property_listing": "listings",
    "mls_listing": "listings",
    "real_estate_listing": "listings",
    "job_listing": "listings",
    "job_posting": "listings",
    "purchase_offer": "offers",
    "real_estate_offer": "offers",
    "claim_confirmation": "confirmations",
    "payment_confirmation": "confirmations",
    "payment_scheduled": "confirmations",
    "transfer_money_confirmation": "confirmations",
    "article": "references",
    "list": "references",
    "webpage": "references",
}


def singular(plural: str) -> str:
    """warranties -> warranty, leases -> lease."""
    return plural[:-3] + "y" if plural.endswith("ies") else plural.removesuffix("s")


def _lines(text: str) -> list[tuple[str, list[str]]]:
    return [(head.strip(), rest.split()) for head, _, rest in (line.partition(":") for line in text.strip().splitlines())]


def normalise(term: str) -> str:
    """Lower case, outer white space off, spaces to underscores; other characters stay."""
    return term.lower().strip().replace(" ", "_")


@dataclass(frozen=True)
class Vocabulary:
    name: str
    domains: dict[str, str] = field(default_factory=dict)  # term or alias -> canonical
    categories: dict[tuple[str, str], str] = field(default_factory=dict)  # (domain, term or alias) -> canonical
    doctypes: dict[str, str] = field(default_factory=dict)
    singulars: dict[str, str] = field(default_factory=dict)

    def domain(self, raw: str) -> str | None:
        return self.domains.get(normalise(raw))

    def category(self, domain: str, raw: str) -> str | None:
        return self.categories.get((domain, normalise(raw)))

    def doctype(self, raw: str) -> str | None:
        return self.doctypes.get(normalise(raw))

    def canonical_domains(self) -> list[str]:
        return sorted(k for k, v in self.domains.items() if k == v)

    def canonical_categories(self, domain: str) -> list[str]:
        return sorted(k for (d, k), v in self.categories.items() if d == domain and k == v)

    def canonical_doctypes(self) -> list[str]:
        return sorted(self.singulars)

    def menu(self) -> str:
        """The options as Markdown, for a prompt; a domain without categories takes any."""
        lines = ["## Valid Classification Options\n", "### Domains and Categories"]
        for domain in self.canonical_domains():
            lines += [f"\n**{domain}**:", f"  - Categories: {', '.join(self.canonical_categories(domain)) or '(any)'}"]
        return "\n".join([*lines, "\n### Document Types", ", ".join(self.canonical_doctypes())])

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """domain (raw, canonical), category (domain, raw, canonical), doctype (raw, canonical), singular (canonical, one)."""
        make = spark.createDataFrame
        return {
            "domain": make(sorted(self.domains.items()), "raw string, canonical string"),
            "category": make(sorted((d, r, c) for (d, r), c in self.categories.items()), "domain string, raw string, canonical string"),
            "doctype": make(sorted(self.doctypes.items()), "raw string, canonical string"),
            "singular": make(sorted(self.singulars.items()), "canonical string, one string"),
        }


def household() -> Vocabulary:
    domains = DOMAIN_ALIASES | {d: d for d in DOMAINS.split()}
    categories = {(domain, alias): target for domain, own in CATEGORY_ALIASES.items() for alias, target in own.items()}
    categories |= {(domain, c): c for domain, own in _lines(CATEGORIES) for c in own}
    plural = DOCTYPES.split()
    doctypes = DOCTYPE_ALIASES | {singular(p): p for p in plural} | {p: p for p in plural}
    return Vocabulary("household", domains, categories, doctypes, {p: singular(p) for p in plural})


_REGISTERED = {"household": household}


def register(name: str, make) -> None:
    _REGISTERED[name.lower()] = make


def available() -> list[str]:
    return sorted(_REGISTERED)


def get(name: str = "household") -> Vocabulary:
    if name.lower() not in _REGISTERED:
        raise ValueError(f"unknown vocabulary {name!r}; available: {', '.join(available())}")
    return _REGISTERED[name.lower()]()
