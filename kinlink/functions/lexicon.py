"""Word lists and sound rules of name and address matching."""

# The results must equal those of the system to be matched.
ABBR = {
    "pvt": "private", "ltd": "limited", "corp": "corporation", "co": "company", "inc": "incorporated", "intl": "international",
    "mfg": "manufacturing", "st": "street", "rd": "road", "ave": "avenue", "blvd": "boulevard", "dr": "drive", "ln": "lane",
    "hwy": "highway", "nr": "near", "opp": "opposite", "apt": "apartment", "bldg": "building", "fl": "floor", "ste": "suite",
    "av": "avenue", "bd": "boulevard", "r": "rue", "pl": "place", "fg": "faubourg", "rte": "route", "chem": "chemin",
    "imp": "impasse", "sq": "square", "ets": "etablissements", "cie": "compagnie",
}
LEGAL = (
    "private", "limited", "corporation", "company", "incorporated", "llc", "llp", "plc", "the", "sarl", "sas", "sa", "eurl", "sasu",
    "sci", "snc", "compagnie", "etablissements", "gmbh",
)
ADDR_STOP = (
    "road", "street", "avenue", "lane", "nagar", "colony", "floor", "house", "plot", "near", "opposite", "sector", "block", "building",
    "cross", "main", "north", "south", "east", "west", "district", "village", "county", "city", "township", "drive", "suite", "ground",
    "first", "second", "phase", "stage", "extension", "layout", "complex", "tower",
)
SOUNDS = (
    ("ksh", "x"), ("ph", "f"), ("th", "t"), ("sh", "s"), ("ck", "k"), ("q", "k"), ("w", "v"), ("z", "s"), ("y", "i"), ("ee", "i"), ("oo", "u"),
)
DIGITS_AS_LETTERS = ("0135", "oles")
