"""The default vocabularies. Each is a parameter of the operators that use it.

Where the order of a vocabulary shows in results (reasons are listed in it), the
terms stand here alphabetically with their rank.
"""

from __future__ import annotations


def ranked(words: dict[str, int]) -> list[str]:
    """The terms by rank."""
    return sorted(words, key=words.__getitem__)


ACCEPT_TERMS = ranked(
    {
        "ambulance": 29, "audiogram": 19, "cardiology": 24, "clinic": 5, "counseling": 35, "dental": 22, "dentist": 21,
        "diagnostic": 14, "dialysis": 28, "doctor": 9, "drug testing": 20, "employee health": 2, "eye care": 31,
        "family medicine": 12, "family practice": 11, "home health": 27.5, "hospital": 8, "imaging": 15, "laboratory": 13.2,
        "medical center": 7, "medical clinic": 6, "medical laboratory": 13.5, "mental health": 34, "nursing home": 27,
        "occupational": 0, "occupational medicine": 1, "optometrist": 30, "orthopedic": 23, "pharmacy": 36, "physical therapy": 25,
        "physician": 10, "primary care": 13, "radiology": 16, "rehabilitation": 26, "spirometry": 18, "surgeon": 33, "surgery": 32,
        "urgent care": 3, "walk-in clinic": 4, "x-ray": 17,
    }
)

REJECT_TERMS = ranked(
    {
        "animal hospital": 7, "apartment": 3, "attorney": 38, "bank": 12, "beauty": 24, "boutique": 39, "bridal": 25, "cannabis": 32,
        "car dealer": 21, "cbd": 33, "church": 8, "clothing store": 22, "fire station": 17, "fireworks": 16, "fishing": 29,
        "flooring": 30, "gas station": 11, "grocery": 10, "hardware": 31, "home builder": 36, "hotel": 2, "insurance": 19,
        "lawyer": 37, "movie": 27, "park": 34, "photographer": 14, "pizza": 1, "plumber": 13, "real estate": 35, "recycling": 18,
        "restaurant": 0, "rv park": 20, "salon": 4, "school": 9, "soccer": 28, "spa": 5, "storage": 15, "sunglasses": 23, "tax": 26,
        "veterinary": 6,
    }
)

HEALTH_TERMS = ranked(
    {
        "cardiology": 18, "clinic": 2, "dental": 7, "dentist": 6, "doctor": 4, "family medicine": 17, "health": 0, "hospital": 3,
        "imaging": 13, "laboratory": 12, "medical": 1, "nursing": 10, "occupational medicine": 15, "orthopedic": 19,
        "physician": 5, "primary care": 16, "radiology": 14, "rehabilitation": 11, "therapy": 8, "urgent care": 9,
    }
)

#: Structured data types that count whatever the words.
HEALTH_TYPES = frozenset(
    {"Dentist", "DiagnosticLab", "EmergencyService", "HealthAndBeautyBusiness", "Hospital", "MedicalBusiness", "MedicalClinic", "Optician", "Pharmacy", "Physician"}
)

PAGING_TERMS = ["/page/", "next", "offset=", "page=", "pagination", "start="]
FOLLOW_TERMS = [
    *(f"{stem}{end}" for stem in ("clinic", "department", "hospital", "location", "office", "practice", "provider", "service") for end in ("", "s")),
    "directory", "facilities", "facility", "find-a-doctor", "find-care", "find-doctor", "health-center", "health-centre", "locator",
    "medical-center", "medical-centre", "register", "registry",
]
SKIP_TERMS = [
    "blog", "calendar", "careers", "cookie", "donate", *(f"{x}.com" for x in ("facebook", "instagram", "linkedin", "twitter", "x", "youtube")),
    "javascript:", "jobs", "login", "logout", "mailto:", "news", "press", "privacy", "sign-in", "signin", "tel:", "terms",
]
SKIP_EXTENSIONS = [f".{x}" for x in sorted("avi css doc docx gif ico jpeg jpg js mov mp3 mp4 png ppt pptx rar svg webp xls xlsx zip".split())]

STATES = sorted(
    "WY WI WV WA VT VA UT TX TN SD SC RI PA OR OK OH NY NV NM NJ NH NE ND NC MT MS MO MN MI ME MD MA LA KY KS IN IL IA ID HI GA FL DE DC CT CO CA AZ AR AK AL".split()
)

#: Country code and the lower-case names that stand for it.
COUNTRY_NAMES = {
    "AE": ["uae", "united arab emirates"], "AR": ["argentina"], "AT": ["austria"], "AU": ["australia"], "BD": ["bangladesh"], "BE": ["belgium"],
    "BH": ["bahrain"], "BR": ["brazil"], "CA": ["canada"], "CH": ["switzerland"], "CL": ["chile"], "CN": ["china"], "CO": ["colombia"],
    "CR": ["costa rica"], "CZ": ["czech republic", "czechia"], "DE": ["germany"], "DK": ["denmark"], "EG": ["egypt"], "ES": ["spain"],
    "ET": ["ethiopia"], "FI": ["finland"], "FR": ["france"], "GB": ["uk", "united kingdom"], "GH": ["ghana"], "GR": ["greece"],
    "ID": ["indonesia"], "IE": ["ireland"], "IL": ["israel"], "IN": ["india"], "IT": ["italy"], "JO": ["jordan"], "JP": ["japan"],
    "KE": ["kenya"], "KR": ["south korea"], "KW": ["kuwait"], "LB": ["lebanon"], "LK": ["sri lanka"], "MA": ["morocco"], "MX": ["mexico"],
    "MY": ["malaysia"], "NG": ["nigeria"], "NL": ["netherlands"], "NO": ["norway"], "NZ": ["new zealand"], "OM": ["oman"], "PA": ["panama"],
    "PE": ["peru"], "PH": ["philippines"], "PK": ["pakistan"], "PL": ["poland"], "PT": ["portugal"], "QA": ["qatar"], "RO": ["romania"],
    "SA": ["saudi arabia"], "SE": ["sweden"], "SG": ["singapore"], "TH": ["thailand"], "TR": ["turkey"],
    "US": ["united states", "united states of america", "usa"], "VN": ["vietnam"], "ZA": ["south africa"],
}
COUNTRY_ALIASES = {name: code for code, names in COUNTRY_NAMES.items() for name in names}

#: Terms that make a page or link of interest to discovery runs.
DISCOVERY_TERMS = ranked(
    {
        "centros de salud": 17, "clinic": 6, "clinics": 7, "clues": 20, "directory": 15, "doctor": 11, "doctors": 12, "facilities": 1,
        "facility": 0, "facility register": 22, "health facilities": 21, "health map": 16, "health services": 23,
        "healthcare locator": 2, "hospital": 8, "hospitals": 9, "locator": 3, "medical": 10, "prestadores": 18, "provider": 4,
        "providers": 5, "register": 14, "registry": 13, "renipress": 19,
    }
)
DISCOVERY_EXTENSIONS = [f".{x}" for x in sorted("css gif ico jpeg jpg js png rar svg zip".split())]

#: Field of a record and the source column names that fill it, first one first.
FIELD_ALIASES = {
    "address": ["address", "full_address", "street_address", "street", "location"],
    "city": ["city", "locality"],
    "email": ["email", "e-mail"],
    "lat": ["lat", "latitude"],
    "lng": ["lng", "lon", "longitude"],
    "name": ["name", "provider_name", "provider", "business name", "facility", "title"],
    "phone": ["phone", "phone_number", "telephone", "tel"],
    "postalCode": ["zip", "zipcode", "postal", "postal code"],
    "services": ["services", "service", "category", "categories", "specialty", "speciality", "provider_type", "type"],
    "sourceUrl": ["sourceurl", "source_url", "maps url", "google maps url", "url"],
    "state": ["state", "region", "province"],
    "website": ["website", "site", "domain"],
}
