"""Word lists, codes and numbers that results depend on."""

# fixed values: words that name tokens leave out
STOPWORDS = ["the", "and", "of", "for", "at", "in", "on", "a", "an", "to", "co"]

# fixed values: legal suffixes and their classes
SUFFIX_CLASSES = {
    "pvt": "pvt", "private": "pvt", "ltd": "ltd", "limited": "ltd", "inc": "inc", "incorporated": "inc", "llc": "llc", "llp": "llp",
    "corp": "corp", "corporation": "corp", "sarl": "sarl", "sas": "sas", "sa": "sa", "gmbh": "gmbh",
}

# fixed values: states of the US by abbreviation
US_STATES = {
    "al": "alabama", "ak": "alaska", "az": "arizona", "ar": "arkansas", "ca": "california", "co": "colorado", "ct": "connecticut",
    "de": "delaware", "fl": "florida", "ga": "georgia", "hi": "hawaii", "id": "idaho", "il": "illinois", "in": "indiana", "ia": "iowa",
    "ks": "kansas", "ky": "kentucky", "la": "louisiana", "me": "maine", "md": "maryland", "ma": "massachusetts", "mi": "michigan",
    "mn": "minnesota", "ms": "mississippi", "mo": "missouri", "mt": "montana", "ne": "nebraska", "nv": "nevada", "nh": "new hampshire",
    "nj": "new jersey", "nm": "new mexico", "ny": "new york", "nc": "north carolina", "nd": "north dakota", "oh": "ohio", "ok": "oklahoma",
    "or": "oregon", "pa": "pennsylvania", "ri": "rhode island", "sc": "south carolina", "sd": "south dakota", "tn": "tennessee",
    "tx": "texas", "ut": "utah", "vt": "vermont", "va": "virginia", "wa": "washington", "wv": "west virginia", "wi": "wisconsin",
    "wy": "wyoming", "dc": "district of columbia",
}

# fixed values: states and territories of India
IN_STATES = [
    "andhra pradesh", "arunachal pradesh", "assam", "bihar", "chhattisgarh", "goa", "gujarat", "haryana", "himachal pradesh", "jharkhand",
    "karnataka", "kerala", "madhya pradesh", "maharashtra", "manipur", "meghalaya", "mizoram", "nagaland", "odisha", "punjab", "rajasthan",
    "sikkim", "tamil nadu", "telangana", "tripura", "uttar pradesh", "uttarakhand", "west bengal", "delhi", "jammu and kashmir", "ladakh",
    "puducherry", "chandigarh",
]

# fixed values: regions and towns of France
FR_REGIONS = [
    "auvergne rhone alpes", "bourgogne franche comte", "bretagne", "centre val de loire", "corse", "grand est", "hauts de france",
    "ile de france", "normandie", "nouvelle aquitaine", "occitanie", "pays de la loire", "provence alpes cote d azur", "bordeaux", "lille",
    "dunkerque", "la teste de buch",
]

# fixed values: street words and landmark words of addresses
STREET_SUFFIXES = ["street", "st", "road", "rd", "avenue", "ave", "drive", "dr", "lane", "ln", "court", "ct", "boulevard", "blvd", "rue", "chemin", "route", "way", "plaza", "circle"]
LANDMARK_WORDS = ["near", "opposite", "opp", "behind", "beside", "next"]

# fixed values: caps and scores by blocking pass, pass numbers and scores by retrieval channel
PASS_CAPS = {1: 5000, 3: 200, 4: 2000, 5: 1000, 6: 50, 7: 500, 8: 300, 9: 100, 10: 30}
PASS_SCORES = {1: 1.0, 4: 0.8, 5: 0.7, 6: 0.5, 7: 0.75, 8: 0.7, 9: 0.65, 10: 0.6}
CHANNEL_PASS = {"name": 11, "addr": 12, "entity": 13, "char": 14, "phonetic": 15}
CHANNEL_SCORE = {"name": 0.9, "addr": 0.85, "entity": 0.8, "char": 0.75, "phonetic": 0.7}
MIN_IDF = 4.0
PAIR_CAP, HYBRID_CAP = 200, 250

STATE_NAMES = sorted({*US_STATES.values(), *IN_STATES, *FR_REGIONS})
