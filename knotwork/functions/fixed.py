"""Fixed values that results depend on: word lists, spelling rules and patterns of business records."""

# --- fixed values, in natural order ---
LEGAL = "inc incorporated llc llp corp corporation co company ltd limited pvt private praivet pte plc lp the and of sarl sas sa eurl sasu sci snc ei com www net org".split()
FR_FILLER = "developpement groupe participations holding distribution international fils associes services france compagnie".split()
FR_NAME = {"st": "saint", "ste": "sainte", "cb": "club", "ctre": "centre", "et": "and"}
FR_REGIONS = ["hauts de france", "nouvelle aquitaine", "pays de la loire", "nord", "pas de calais", "gironde", "loire atlantique"]
NAME_FIX = [
    (r"\bs a s u\b", "sasu"), (r"\bs a r l\b", "sarl"), (r"\be u r l\b", "eurl"), (r"\bs a s\b", "sas"), (r"\bs c i\b", "sci"), (r"\bs n c\b", "snc"),
    (r"\bs a\b", "sa"), (r"\b5arl\b", "sarl"), (r"\b5asu\b", "sasu"), (r"\b5as\b", "sas"), (r"\bcie\b", "compagnie"), (r"\bfrs\b", "freres"),
]
ALIAS = r"^.*?\b(?:dba|d b a|doing business as|trading as|formerly known as|formerly|f k a|fka|a k a|aka|nee)\b\s*"
ADDRESS = {
    "st": "street", "rd": "road", "ave": "avenue", "av": "avenue", "dr": "drive", "ln": "lane", "blvd": "boulevard", "bd": "boulevard", "ct": "court",
    "cir": "circle", "pl": "place", "hwy": "highway", "pkwy": "parkway", "trl": "trail", "ter": "terrace", "sq": "square", "mt": "mount", "ft": "fort",
    "n": "north", "s": "south", "e": "east", "w": "west", "ne": "northeast", "nw": "northwest", "se": "southeast", "sw": "southwest", "apt": "unit",
    "apartment": "unit", "ste": "unit", "suite": "unit", "bldg": "building", "flr": "floor", "fl": "floor", "nagr": "nagar", "opp": "opposite",
    "nr": "near", "distt": "district", "dist": "district", "null": "", "no": "", "h": "", "door": "", "flat": "", "plot": "", "po": "", "box": "", "ndeg": "",
}
ADDRESS_FR = {
    **{k: v for k, v in ADDRESS.items() if k not in "n s e w ne nw se sw ter".split()},
    "st": "saint", "ste": "sainte", "n": "", "r": "rue", "ave": "avenue", "av": "avenue", "all": "allee", "bd": "boulevard", "blvd": "boulevard",
    "imp": "impasse", "rte": "route", "ch": "chemin", "pl": "place", "crs": "cours", "q": "quai", "res": "residence", "psg": "passage", "pass": "passage", "bld": "boulevard",
}
STATES = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co", "connecticut": "ct", "delaware": "de",
    "florida": "fl", "georgia": "ga", "hawaii": "hi", "idaho": "id", "illinois": "il", "indiana": "in", "iowa": "ia", "kansas": "ks", "kentucky": "ky",
    "louisiana": "la", "maine": "me", "maryland": "md", "massachusetts": "ma", "michigan": "mi", "minnesota": "mn", "mississippi": "ms", "missouri": "mo",
    "montana": "mt", "nebraska": "ne", "nevada": "nv", "new hampshire": "nh", "new jersey": "nj", "new mexico": "nm", "new york": "ny",
    "north carolina": "nc", "north dakota": "nd", "ohio": "oh", "oklahoma": "ok", "oregon": "or", "pennsylvania": "pa", "rhode island": "ri",
    "south carolina": "sc", "south dakota": "sd", "tennessee": "tn", "texas": "tx", "utah": "ut", "vermont": "vt", "virginia": "va", "washington": "wa",
    "west virginia": "wv", "wisconsin": "wi", "wyoming": "wy", "district of columbia": "dc",
    "tamil nadu": "tn", "tamilnadu": "tn", "west bengal": "wb", "uttar pradesh": "up", "madhya pradesh": "mp", "andhra pradesh": "ap",
    "himachal pradesh": "hp", "arunachal pradesh": "arp", "maharashtra": "mh", "karnataka": "ka", "kerala": "kl", "gujarat": "gj", "rajasthan": "rj",
    "haryana": "hr", "punjab": "pb", "telangana": "tg", "odisha": "od", "orissa": "od", "bihar": "br", "jharkhand": "jh", "assam": "as",
    "chhattisgarh": "cg", "uttarakhand": "uk", "goa": "ga", "delhi": "dl", "new delhi": "dl", "jammu and kashmir": "jk", "chandigarh": "ch",
    "puducherry": "py", "pondicherry": "py",
}
SOUND = [
    ("tion", "shn"), ("x", "ks"), ("ph", "f"), ("gh", ""), ("ck", "k"), ("q", "k"), ("c([eiy])", "s$1"), ("c", "k"), ("g([eiy])", "j$1"), ("sh", "s"),
    ("w", "v"), ("z", "j"), ("m([^aeiouyhbpm ])", "n$1"), ("h", ""), ("[aeiouy]", ""),
]
INITIALS = r"^[A-Z]{2,4}$"
WEB = r"(?i)^[a-z0-9]+\.(com|fr|net|org|in|co)$|^[#@][A-Za-z0-9]+$"
DECOY_WORDS = "groupe developpement france participations distribution international holding sarl sas sa sasu eurl sci snc ei".split()
# --- end of fixed values ---

#: Latin letters and what they fold to; the same pair serves Spark and SQL.
FOLD = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")

# --- fixed values of the edit explanation and the organisation-word rules, in natural order ---
EDIT_LEGAL = "inc incorporated llc llp corp corporation co company ltd limited pvt private pte plc lp pc pllc sarl sas sa eurl sasu sci snc ei".split()
EDIT_FILLER = "group groupe services international enterprises developpement development compagnie associes associates fils sons freres brothers holding holdings participations distribution france trust partners center centre solutions global industries trading sri shri mr ms cie and et".split()
EDIT_GENERIC = "club ecole amicale comite sportive amis parents union primaire college maison societe pharmacie fetes loisirs federation anciens sante culture culturel culturelle jeunes association art sport elementaire maternelle residence groupement lycee foyer institut cercle atelier musique gestion solidarite entraide etablissements ets".split()
ARTICLES = "the of de du des la le les d l".split()
ORG = "club ecole amicale comite sportive amis centre parents union primaire college maison societe pharmacie fetes loisirs federation anciens sante culture culturel culturelle jeunes association art sport elementaire maternelle residence groupement lycee foyer institut cercle atelier musique gestion solidarite entraide etablissements ets".split()
ORG_FILLER = "groupe developpement france services associes fils and et holding participations distribution international compagnie cie freres de du des la le les d l".split()
ORG_NEW = "section collectif service patrimoine danse ehpad theatre conseil soins sportif medico agricole ateliers auto clinique cafe energie concept etablissement medical hopital automobile restaurant travaux transports eau batiment garage restauration bar immobiliere transport hotel construction peinture coiffure immobilier gaz logistique finance finances industrie elevage btp immo menuiserie".split()
GENERIC_CORE = ORG[:35] + "groupe developpement compagnie services associes fils freres holding participations distribution international france and de du des la le les d l et".split()
DROPPED_KINDS = ["swap", "org added", "org added (other drop)", "org dropped + filler (other add)"]
# --- end of fixed values ---

# --- fixed values of the linking keys, in natural order ---
KEY_NOISE = (
    "sarl sas sasu eurl sa sci snc ei s a r l u e i c com groupe developpement international participations distribution holding services associes et and france frnce "
    "de du des la le les d cie fils freres frs dba aka fka formerly doing business as known nee trading enterprises labs sys co one 5arl 5as societe ste ets etablissements compagnie"
).split()
KEY_ADDRESS = {
    "rue": "rue", "r": "rue", "avenue": "avenue", "av": "avenue", "ave": "avenue", "allee": "allee", "all": "allee", "boulevard": "boulevard", "bd": "boulevard",
    "blvd": "boulevard", "impasse": "impasse", "imp": "impasse", "route": "route", "rte": "route", "chemin": "chemin", "ch": "chemin", "place": "place", "pl": "place",
    "cours": "cours", "crs": "cours", "quai": "quai", "q": "quai", "st": "saint", "ste": "sainte", "no": "", "ndeg": "", "n": "", "b": "bis", "t": "ter",
    "de": "", "du": "", "des": "", "la": "", "le": "", "les": "", "d": "", "l": "",
}
KEY_REGIONS = ["hauts", "france", "nouvelle", "aquitaine", "pays", "loire", "nord", "gironde", "atlantique", "pas", "calais"]
# --- end of fixed values ---
