"""Word lists and tables of the linkage rules. Results depend on exactly these."""

from __future__ import annotations

#: Trailing legal-form words of the reduced name view.
LEGAL_ENDINGS = (
    "inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "limited", "llc", "llp", "lp", "plc", "pvt", "private",
    "gmbh", "sa", "sarl", "bv", "ag", "pty", "pc", "group", "holdings", "enterprises", "enterprise", "industries", "international", "intl",
)
#: French forms of the per-country view.
LEGAL_ENDINGS_FR = ("sarl", "sas", "sasu", "sci", "eurl", "sa")
#: Legal-form words that the variation labels look at.
LEGAL_WORDS = ("inc", "incorporated", "llc", "ltd", "limited", "pvt", "private", "corp", "corporation", "co", "company", "llp", "lp", "pllc", "pc")
#: Abbreviations of names, and of addresses besides.
NAME_ABBREVIATIONS = {
    "rd": "road", "st": "street", "ave": "avenue", "blvd": "boulevard", "dr": "drive", "ln": "lane", "ct": "court", "hwy": "highway",
    "apt": "apartment", "fl": "floor", "ste": "suite", "pvt": "private", "ltd": "limited", "corp": "corporation", "inc": "incorporated", "co": "company",
}
DIRECTIONS = {"n": "north", "s": "south", "e": "east", "w": "west", "ne": "northeast", "nw": "northwest", "se": "southeast", "sw": "southwest"}
ADDRESS_ABBREVIATIONS = NAME_ABBREVIATIONS | DIRECTIONS
#: Address abbreviations by country, under the names of the country; `st` is a street in the one and a saint in the other.
COUNTRY_ABBREVIATIONS = {
    ("us", "usa", "united states"): ADDRESS_ABBREVIATIONS,
    ("in", "india"): {"rd": "road", "st": "street", "ngr": "nagar", "opp": "opposite", "nr": "near", "bldg": "building", "flr": "floor"},
    ("fr", "france"): {"av": "avenue", "bd": "boulevard", "pl": "place", "st": "saint", "ste": "sainte", "rte": "route", "all": "allee", "imp": "impasse"},
}
#: US states and their codes.
STATES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado", "CT": "Connecticut",
    "DE": "Delaware", "DC": "District of Columbia", "FL": "Florida", "GA": "Georgia", "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois",
    "IN": "Indiana", "IA": "Iowa", "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine", "MD": "Maryland",
    "MA": "Massachusetts", "MI": "Michigan", "MN": "Minnesota", "MS": "Mississippi", "MO": "Missouri", "MT": "Montana", "NE": "Nebraska",
    "NV": "Nevada", "NH": "New Hampshire", "NJ": "New Jersey", "NM": "New Mexico", "NY": "New York", "NC": "North Carolina",
    "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma", "OR": "Oregon", "PA": "Pennsylvania", "RI": "Rhode Island",
    "SC": "South Carolina", "SD": "South Dakota", "TN": "Tennessee", "TX": "Texas", "UT": "Utah", "VT": "Vermont", "VA": "Virginia",
    "WA": "Washington", "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming",
}
STATE_CODES = {name.lower(): code for code, name in STATES.items()} | {code.lower(): code for code in STATES}
#: Words that tell a street from a city, markers of units and of landmarks, honorifics, null words.
STREET_WORDS = (
    "road", "street", "avenue", "unit", "apt", "suite", "rd", "st", "dr", "ln", "ct", "ave", "blvd", "boulevard", "drive", "lane", "court",
    "hwy", "highway", "pkwy", "parkway", "way", "terrace", "circle", "pl", "place", "cove", "pass", "trail", "crescent",
)
UNIT_WORDS = ("unit", "apartment", "suite", "floor", "po", "box", "pmb")
LANDMARK_WORDS = ("near", "opposite", "opp", "behind", "beside")
HONORIFICS = ("mr", "mrs", "ms", "dr", "shri", "sri")
NULL_WORDS = ("null", "none", "nan")
NULL_FIELDS = ("", "null", "none", "nan", "n/a")
#: Digits read as letters.
LEET_FROM, LEET_TO = "013457", "oieast"
