"""Word lists, field names and patterns that define the results. Plain and in their natural order."""

# Words that are no aspect by themselves or at an edge of one.
PRONOUNS = """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself
it its itself they them their theirs themselves what which who whom this that these those someone somebody something anyone
anybody anything everyone everybody everything nobody nothing none""".split()
STOPWORDS = """a an the and or but if because as until while of at by for with about against between into through during
before after above below to from up down in out on off over under again further then once here there when where why how all
any both each few more most other some such no nor not only own same so than too very s t can will just don should now d ll
m o re ve y ain aren couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn also
really even""".split()
GENERIC_NOUNS = """thing things stuff item items product products everything nothing something anything aspect aspects feature
features lot bit way part parts side point points time times day days week weeks month months year years one ones people
person case cases use uses review reviews star stars purchase purchases buy order orders price money amount deal reason
reasons problem problems issue issues experience factor piece pieces model models unit units version versions brand brands
type types""".split()
STANDALONE_GENERIC = """quality performance comfort durability feel look looks size weight design style function value speed
appearance fit work action behavior nature""".split()
COPULAS_AND_CONJUNCTIONS = """is are was were be been being has have had do does did but however although though while whereas
because since so and or feel feels felt works worked working seems seemed looked looks sounded sounds left bought got get gets
ordered delivered""".split()
OPINION_WORDS = """good bad great terrible awful excellent poor amazing horrible wonderful fantastic decent superb fine mediocre
subpar outstanding impressive unimpressive disappointing pleasing unacceptable satisfactory unsatisfactory exceptional abysmal
flawless dreadful gorgeous lovely surprising surprisingly ordinary uneventful happier happy unhappy perfect""".split()

# Words that forbid a merge when they are all that two phrases share, and accessory words.
GENERIC_MODIFIERS = """quality performance comfort durability design speed power level value feature feel look material size
weight mode option rate efficiency sound""".split()
ACCESSORIES = "protector cover case sleeve adapter cable stand".split()
DISALLOWED_MERGES = [
    ("screen", "screen protector"),
    ("phone", "phone case"),
    ("sound quality", "build quality"),
    ("battery performance", "gaming performance"),
    ("camera", "camera lens protector"),
    ("laptop", "laptop sleeve"),
]
ALIASES = {
    "display": "screen", "screen": "screen", "monitor": "screen", "panel": "screen", "lcd": "screen", "oled": "screen",
    "touchscreen": "touchscreen", "battery life": "battery", "battery backup": "battery", "runtime": "battery",
    "battery": "battery", "charging speed": "charging", "charger": "charger", "sound": "audio", "sound quality": "audio quality",
    "audio": "audio", "speakers": "speaker", "speaker": "speaker", "microphone": "microphone", "mic": "microphone",
    "keyboard": "keyboard", "keys": "keyboard", "key travel": "keyboard", "trackpad": "trackpad", "touchpad": "trackpad",
    "mouse": "mouse", "build": "build quality", "build quality": "build quality", "construction": "build quality",
    "craftsmanship": "build quality", "comfort": "comfort", "ergonomics": "ergonomics", "fit": "fit", "sizing": "fit",
    "customer support": "customer service", "customer service": "customer service", "support": "customer service",
    "warranty": "warranty", "return policy": "returns", "delivery speed": "shipping", "shipping": "shipping",
    "delivery": "shipping", "box": "packaging", "packaging": "packaging", "unboxing": "packaging",
}

# Kinds of aspects by words within the surface, in order of precedence, then by words in the sentence.
TYPE_WORDS = [
    ("delivery", ["delivery", "shipping", "shipped", "shipment", "carrier", "ups", "fedex", "usps", "dhl", "transit", "delivered", "arrived", "arrival", "courier", "tracking", "package transit"]),
    ("packaging", ["packaging", "box", "package", "bubble wrap", "unboxing", "container", "wrapped", "wrapping", "seal", "packaged"]),
    ("service", ["customer service", "customer support", "support", "warranty", "refund", "return", "replacement", "representative", "helpdesk", "call center", "repair", "policy", "guarantee"]),
    ("seller", ["seller", "merchant", "vendor", "store", "dealer", "dealership", "third-party seller", "retailer", "fulfillment"]),
]
# The shorter lists by which a candidate is typed as it is found.
CANDIDATE_TYPE_WORDS = [
    ("delivery", ["delivery", "shipping", "shipped", "arrived", "carrier", "ups", "fedex", "usps", "transit"]),
    ("packaging", ["packaging", "box", "package", "wrapped", "wrapping", "unboxing", "bubble wrap", "container"]),
    ("service", ["customer service", "support", "warranty", "refund", "return", "replacement", "representative"]),
    ("seller", ["seller", "merchant", "vendor", "store", "dealership"]),
]
CONTEXT_DELIVERY = ["amazon delivered", "amazon shipped", "amazon arrived", "amazon delivery"]
CONTEXT_PACKAGING = ["arrived damaged in box", "opened the packaging", "poor packaging"]
CONTEXT_PACKAGING_SURFACE = ["box", "package", "wrapper", "container"]
CONTEXT_SERVICE = ["contacted support", "customer care", "warranty claim"]
CONTEXT_SELLER = ["seller responded", "seller refunded", "shady seller"]

# Raw field names of known exports.
FIELD_NAMES = {
    "rating": "rating", "overall": "rating", "star_rating": "rating", "title": "title", "reviewTitle": "title", "summary": "title",
    "text": "text", "reviewText": "text", "review_body": "text", "reviewerID": "user_id", "user_id": "user_id",
    "asin": "product_id", "product_id": "product_id", "parent_asin": "parent_product_id", "parent_product_id": "parent_product_id",
    "verified_purchase": "verified_purchase", "verified": "verified_purchase", "helpful_vote": "helpful_vote",
    "helpful": "helpful_vote", "vote": "helpful_vote", "timestamp": "timestamp", "unixReviewTime": "timestamp",
    "reviewTime": "timestamp", "date": "timestamp", "main_category": "category", "category": "category", "categories": "category",
}

# Titles never end a sentence; abbreviations only before a capitalised word of two letters or more.
TITLES = "mr mrs ms dr prof sr jr rev gen sgt cpl pvt capt lt col maj cmdr adm".split()
SHORT_FORMS = "st ave blvd vs etc inc ltd corp co dept univ jan feb mar apr jun jul aug sep oct nov dec fig eq vol no approx est min max viz cf".split()

# Cleaning patterns.
HTML_TAG = r"<[^>]+>"
HTML_ENTITY = r"&[a-zA-Z]+;|&#\d+;|&#x[0-9a-fA-F]+;"
URL = r"""https?://[^\s<>"']+|www\.[^\s<>"']+"""
EMAIL = r"\S+@\S+\.\S+"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
TOKEN = r"[A-Za-z0-9]+(?:-[A-Za-z0-9]+)?"

# Frequent words of languages in Latin letters, by which a text's language is told.
LANGUAGE_WORDS = {
    "en": "the and of to is was it for with that this not but have my from are after very".split(),
    "de": "der die das und ist nicht ein eine mit für auf den von sehr war im nach aber bei".split(),
    "fr": "le la les et est une des pas pour dans que du avec très sur ce mais au était".split(),
    "es": "el la los y es una de no para con que del en muy por se pero las este".split(),
    "it": "il la che e di non una per con sono del molto questo ma della gli anche nel".split(),
    "pt": "o a que e de não uma para com os do da em muito este mas foi por na".split(),
    "nl": "de het een en is niet van met voor op dat maar zeer was deze bij naar ook".split(),
}
