"""Word lists, tables and patterns that results depend on, stated as they are."""

LEGAL_SUFFIXES = (
    "inc", "incorporated", "llc", "ltd", "limited", "corp", "corporation", "co", "company", "llp", "lp", "plc", "pvt", "private", "gmbh",
    "sarl", "sas", "sasu", "sa", "eurl", "sci", "snc", "gie", "लिमिटेड", "प्राइवेट", "प्रा", "लि",
)
LEGAL_PHRASES = (
    "private limited", "pvt ltd", "pvt limited", "co ltd", "co limited", "co inc", "co corp", "co llc", "soc anonyme", "प्राइवेट लिमिटेड", "प्रा लि",
)
STREET_ABBREVIATIONS = {
    "st": "street", "rd": "road", "ave": "avenue", "dr": "drive", "blvd": "boulevard", "ln": "lane", "ct": "court", "pkwy": "parkway", "pl": "place",
    "ter": "terrace", "cir": "circle", "hwy": "highway", "fwy": "freeway", "ste": "suite", "apt": "apartment", "fl": "floor", "bldg": "building",
    "av": "avenue", "bd": "boulevard", "all": "allee", "rte": "route", "ch": "chemin",
}
ADDRESS_STOPWORDS = (
    "near", "nr", "behind", "opp", "opposite", "next", "to", "beside", "adjacent", "at", "in", "on", "of", "and", "the", "floor", "fl", "nd", "th",
    "st", "rd", "phase", "sector", "sec", "block", "blk", "tower", "building", "bldg",
)
GENERIC_NAME_TERMS = (
    "and", "the", "of", "in", "at", "for", "on", "a", "an", "to", "by", "is", "or", "de", "la", "le", "des", "du", "et", "en", "les",
    "group", "services", "care", "health", "center", "centre", "management", "consulting", "solutions", "international", "enterprises", "holdings",
    "systems", "trading", "industries", "associates", "global", "national", "tech", "technology", "technologies", "clinic", "hospital", "club", "amicale",
    "inc", "incorporated", "llc", "ltd", "limited", "corp", "corporation", "co", "company", "pvt", "private", "sarl", "sas", "sasu", "sa", "eurl", "sci",
    "लिमिटेड", "प्राइवेट",
)
#: A labelled number of a house, plot or door; a number that starts a part between commas; any number with a letter.
LABELLED_NUMBER = r"\b(?:h\.?\s*no\.?|house\s*no\.?|flat\s*no\.?|plot\s*no\.?|door\s*no\.?|sub\s*plot\s*no\.?|unit\s*no\.?|ews)\s*[-:#]?\s*([a-zA-Z0-9/-]+)"
SEGMENT_NUMBER = r"^\s*([0-9]+(?:[/-][0-9a-zA-Z]+)?|[0-9]+[a-zA-Z]?)\b"
PLAIN_NUMBER = r"\b\d+[a-zA-Z]?\b"

MODEL_FEATURES = (
    "name_token_jaccard", "name_token_overlap_count", "name_char_ngram_cosine", "name_edit_similarity", "name_length_ratio", "name_exact_match",
    "name_first_token_match", "address_token_jaccard", "address_token_overlap_count", "address_house_number_match", "address_edit_similarity",
    "address_length_ratio", "address_missing", "country_match", "source_is_s2", "source_is_s3", "name_length_ratio_context", "address_length_ratio_context",
)

# Profiling alone.
PROFILE_SUFFIXES = ("inc", "incorporated", "llc", "ltd", "limited", "pvt", "private", "corp", "corporation", "co", "company", "gmbh", "sa", "sas", "sarl", "llp", "lp", "plc")
PROFILE_STOPWORDS = ("and", "the", "of", "in", "at", "for", "on", "a", "an", "to", "by", "is", "or", "de", "la", "le", "des", "du", "et", "en", "les")
US_STATES = tuple("AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC".split())
INDIA_STATES = (
    "andhra pradesh", "arunachal pradesh", "assam", "bihar", "chhattisgarh", "goa", "gujarat", "haryana", "himachal pradesh", "jharkhand", "karnataka",
    "kerala", "madhya pradesh", "maharashtra", "manipur", "meghalaya", "mizoram", "nagaland", "odisha", "punjab", "rajasthan", "sikkim", "tamil nadu",
    "telangana", "tripura", "uttar pradesh", "uttarakhand", "west bengal", "delhi", "chandigarh", "puducherry", "jammu", "kashmir",
    "ap", "ts", "up", "mp", "tn", "ka", "mh", "wb", "gj", "rj", "pb", "hr", "kl",
)
FRANCE_WORDS = ("idf", "ile", "france", "paris", "rhone", "gironde")
US_ZIP = r"\b\d{5}(?:-\d{4})?\b"
INDIA_PIN = r"\b[1-9]\d{5}\b"
FRANCE_POSTAL = r"\b(?:0[1-9]|[1-8]\d|9[0-8])\d{3}\b"
SEPARATORS = r"[,;/|\n]"
ADDRESS_ABBREVIATIONS = (
    "st", "street", "rd", "road", "ave", "avenue", "dr", "drive", "blvd", "boulevard", "ln", "lane", "ct", "court", "pkwy", "parkway", "ste", "suite",
    "apt", "apartment", "fl", "floor", "no", "plot", "opp", "opposite", "nr", "near", "sec", "sector", "bldg", "building", "hwy", "highway", "rue", "bd",
    "av", "all", "chemin", "route",
)
