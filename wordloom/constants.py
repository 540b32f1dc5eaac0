"""Fixed values that define results: word lists and limits."""

# The 126 English stopwords every word count leaves out.
STOPWORDS = frozenset("""
a about above after again against all am an and any are as at be because been before being below
between both but by can did do does doing don down during each few for from further had has have
having he her here hers herself him himself his how i if in into is it its itself just me more most
my myself no nor not now of off on once only or other our ours ourselves out over own same she
should so some such than that the their theirs them themselves then there these they this those
through to too under until up very was we were what when where which while who whom why will with
would you your yours yourself yourselves
""".split())

# Topic modeling keeps "don" and also leaves out four modal verbs.
TOPIC_STOPWORDS = (STOPWORDS - {"don"}) | {"cannot", "could", "might", "must"}

# Words that a recognizer often takes for a person.
PERSON_NOISE = frozenset("""
adequate smaller larger higher lower horizontal vertical approved general special additional
standard minimum maximum total full main suitable appropriate accessible fixed required
""".split())

# Entity group and the substrings of the type that select it, first match wins.
ENTITY_GROUPS = [
    ("ORG", ["ORG"]),
    ("PERSON", ["PERSON"]),
    ("GPE", ["GPE"]),
    ("DATE", ["DATE", "TIME"]),
    ("CARDINAL_MONEY", ["CARDINAL", "MONEY", "PERCENT", "QUANTITY"]),
    ("LOC", ["LOC"]),
    ("FACILITY", ["FAC"]),
    ("PRODUCT", ["PRODUCT"]),
    ("EVENT", ["EVENT"]),
]

# Column names that point to text and to labels.
TEXT_NAME_HINTS = ["text", "content", "message", "review", "comment", "body", "description",
                   "sentence", "document", "email", "tweet", "sms"]
LABEL_NAME_HINTS = ["label", "labels", "class", "classes", "category", "categories", "target",
                    "sentiment", "topic", "tag", "y"]

# Names under which a row may carry its text, in order of preference.
TEXT_FIELDS = ["text", "email", "Message", "message", "body", "content"]

# Numeric defaults of the reports.
MAX_TOP_N = 1000
NETWORK_MAX_LINKS = 120
LENGTH_BUCKETS = 12
MAX_HEADER_CELL = 45
DELIMITERS = ["\t", ",", ";", "|"]
