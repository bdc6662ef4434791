"""Fixed values. They must equal the published study's values for results to agree."""

# Class ids and their names.
LABEL_NAMES = {1: "World", 2: "Sports", 3: "Business", 4: "Science/Tech"}

# Top-level domains and other tokens of web addresses.
TOP_LEVEL_DOMAINS = ["com", "org", "net", "edu", "gov", "info", "biz"]
WEB_TOKENS = ["http", "www", "href", "aspx"] + TOP_LEVEL_DOMAINS

# Weekdays and their abbreviations.
WEEKDAYS = [
    "Monday", "Mon", "Tuesday", "Tue", "Tues", "Wednesday", "Wed", "Thursday", "Thu", "Thurs",
    "Friday", "Fri", "Saturday", "Sat", "Sunday", "Sun",
]

# The short stop list applied before embedding.
EMBED_STOP_WORDS = [
    "and", "to", "in", "the", "of", "for", "on", "as", "is", "ap", "by", "has", "reuters", "that", "an",
    "was", "at", "with", "its", "be", "from", "it", "his", "will", "are", "he", "have", "this", "but",
]

# The common English stop list (179 words).
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his
himself she she's her hers herself it it's its itself they them their theirs themselves what which who whom this
that that'll these those am is are was were be been being have has had having do does did doing a an the and but
if or because as until while of at by for with about against between into through during before after above
below to from up down in out on off over under again further then once here there when where why how all any
both each few more most other some such no nor not only own same so than too very s t can will just don don't
should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn
hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn
wasn't weren weren't won won't wouldn wouldn't
""".split()

# Country names in search order.
COUNTRIES = [
    "Afghanistan", "Albania", "Algeria", "Andorra", "Angola", "Antigua and Barbuda", "Argentina", "Armenia",
    "Australia", "Austria", "Azerbaijan", "Bahamas", "Bahrain", "Bangladesh", "Barbados", "Belarus", "Belgium",
    "Belize", "Benin", "Bhutan", "Bolivia", "Bosnia and Herzegovina", "Botswana", "Brazil", "Brunei", "Bulgaria",
    "Burkina Faso", "Burundi", "Côte d'Ivoire", "Cabo Verde", "Cambodia", "Cameroon", "Canada",
    "Central African Republic", "Chad", "Chile", "China", "Colombia", "Comoros", "Congo (Congo-Brazzaville)",
    "Costa Rica", "Croatia", "Cuba", "Cyprus", "Czechia (Czech Republic)", "Democratic Republic of the Congo",
    "Denmark", "Djibouti", "Dominica", "Dominican Republic", "Ecuador", "Egypt", "El Salvador",
    "Equatorial Guinea", "Eritrea", "Estonia", "Eswatini (fmr. 'Swaziland')", "Ethiopia", "Fiji", "Finland",
    "France", "Gabon", "Gambia", "Georgia", "Germany", "Ghana", "Greece", "Grenada", "Guatemala", "Guinea",
    "Guinea-Bissau", "Guyana", "Haiti", "Holy See", "Honduras", "Hungary", "Iceland", "India", "Indonesia", "Iran",
    "Iraq", "Ireland", "Israel", "Italy", "Jamaica", "Japan", "Jordan", "Kazakhstan", "Kenya", "Kiribati",
    "Kuwait", "Kyrgyzstan", "Laos", "Latvia", "Lebanon", "Lesotho", "Liberia", "Libya", "Liechtenstein",
    "Lithuania", "Luxembourg", "Madagascar", "Malawi", "Malaysia", "Maldives", "Mali", "Malta",
    "Marshall Islands", "Mauritania", "Mauritius", "Mexico", "Micronesia", "Moldova", "Monaco", "Mongolia",
    "Montenegro", "Morocco", "Mozambique", "Myanmar (formerly Burma)", "Namibia", "Nauru", "Nepal", "Netherlands",
    "New Zealand", "Nicaragua", "Niger", "Nigeria", "North Korea", "North Macedonia", "Norway", "Oman", "Pakistan",
    "Palau", "Palestine State", "Panama", "Papua New Guinea", "Paraguay", "Peru", "Philippines", "Poland",
    "Portugal", "Qatar", "Romania", "Russia", "Rwanda", "Saint Kitts and Nevis", "Saint Lucia",
    "Saint Vincent and the Grenadines", "Samoa", "San Marino", "Sao Tome and Principe", "Saudi Arabia", "Senegal",
    "Serbia", "Seychelles", "Sierra Leone", "Singapore", "Slovakia", "Slovenia", "Solomon Islands", "Somalia",
    "South Africa", "South Korea", "South Sudan", "Spain", "Sri Lanka", "Sudan", "Suriname", "Sweden",
    "Switzerland", "Syria", "Tajikistan", "Tanzania", "Thailand", "Timor-Leste", "Togo", "Tonga",
    "Trinidad and Tobago", "Tunisia", "Turkey", "Turkmenistan", "Tuvalu", "Uganda", "Ukraine",
    "United Arab Emirates", "United Kingdom", "United States of America", "Uruguay", "Uzbekistan", "Vanuatu",
    "Venezuela", "Vietnam", "Yemen", "Zambia", "Zimbabwe",
]

# Keyword sets that suggest a class for a topic (first five words, first set that hits wins).
TOPIC_KEYWORDS = {
    "SPORTS": ["game", "team", "season", "win"],
    "BUSINESS": ["compani", "stock", "market", "business"],
    "SCIENCE/TECH": ["microsoft", "softwar", "comput", "internet"],
    "WORLD": ["said", "presid", "minist", "countri"],
}

# Keyword sets of a clear topic (first three words) and the share that counts as coherent.
CLEAR_TOPIC_KEYWORDS = [
    ["game", "team", "season"],
    ["compani", "stock", "market"],
    ["presid", "minist", "govern"],
]
CLEAR_TOPIC_SHARE = 0.7

# Accuracy bands, lower bounds exclusive.
RATING_BANDS = [(0.8, "very good"), (0.7, "good"), (0.6, "ok")]
RATING_BANDS_REST = "not so good"
SUCCESS_BANDS = [(0.75, "very successful"), (0.6, "successful")]
SUCCESS_BANDS_REST = "partly successful"

# Metric names of the comparison tables.
CLUSTER_METRICS = ["ARI", "NMI", "Homogeneity", "Completeness", "V-Measure"]
BEST_MODEL_METRICS = CLUSTER_METRICS + ["Aligned_Accuracy"]
