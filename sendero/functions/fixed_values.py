"""Fixed values.

Word lists, codes, thresholds and formats which results depend on. They are data, not logic:
change them only together with the published datasets.
"""

# --- cadastral addresses -------------------------------------------------------------------

EXPECTED_SRS = "urn:ogc:def:crs:EPSG::25830"
NO_NUMBER_SOURCE = "S-N"
NO_NUMBER_DISPLAY = "S/N"

# thoroughfare code -> word put before the zone name
RURAL_TYPES = {
    "PD": "",
    "DS": "",
    "LG": "",
    "CM": "Camino",
    "VR": "Vereda",
    "CR": "Carretera",
    "BO": "Barrio",
    "HT": "",
    "PG": "Polígono",
    "PL": "",
    "PB": "",
    "CS": "",
    "AL": "",
}
# code -> word used when the zone alone is a number or at most two characters
FALLBACK_WORDS = {
    "PD": "Partida",
    "DS": "Diseminado",
    "LG": "Lugar",
    "HT": "Huerta",
    "PB": "Poblado",
    "CS": "Caserío",
    "AL": "Aldea",
}
RURAL_PL_KEYWORDS = ["PARTID", "DISEMIN", "PARAJE", "CASERIO", "CASERÍO", "ALQUERIA", "MASIA"]
RURAL_PL_ZONES = [("03005", "PL MOS DEL BOU")]
TRAILING_ARTICLES = ["DE LAS", "DE LOS", "DE LA", "DEL", "LAS", "LOS", "LA", "EL"]
MINOR_WORDS = ["de", "del", "el", "la", "los", "las", "y"]
ABBREVIATIONS = {
    "CR": "Carretera",
    "VD": "Vereda",
    "CMNO": "Camino",
    "CEMENTERI": "Cementerio",
}
SAINT_ABBREVIATIONS = {"S": "San", "STA": "Santa", "STO": "Santo"}
PROPER_NOUN_ACCENTS = {"JOSE": "José", "AGUEDA": "Águeda"}

# (municipality, cleaned zone, display name)
CANONICAL_ZONE_NAMES = [
    ("03005", "Atalayas", "Las Atalayas"),
    ("03005", "Lomas", "Las Lomas"),
    ("03005", "Rincon", "El Rincón"),
    ("03005", "Sierra", "La Sierra"),
    ("03005", "Moco", "El Moco"),
    ("03005", "Dehesa", "La Dehesa"),
    ("03005", "Huerta la 17", "La Huerta"),
    ("03015", "Eralta", "La Eralta"),
    ("03015", "Puente D Pedro", "Puente Don Pedro"),
    ("03059", "San Antonio Florida", "San Antonio de la Florida"),
    ("03059", "La Pla", "El Plà"),
]
# (municipality, display name) of zones known under two spellings
DISTANCE_MERGE_ZONES = [("03059", "San Antonio de la Florida")]
MERGE_DISTANCE_METRES = 150.0
SN_DEDUP_METRES = 1.0

# urban parcel reference -> registered designator
REF_LABELS = {
    "0861501XH8206S": "Parcela 34",
    "0861502XH8206S": "Parcela 33",
    "0861503XH8206S": "Parcela 32",
    "0861504XH8206S": "Parcela 31",
    "0861505XH8206S": "Parcela 30",
    "0960301XH8206S": "Parcela 22",
    "0960302XH8206S": "Parcela 23",
    "0960303XH8206S": "Parcela 24",
    "0960304XH8206S": "Parcela 25",
    "0960305XH8206S": "Parcela 26",
    "0960306XH8206S": "Parcela 27",
    "0960307XH8206S": "Parcela 28",
    "0960308XH8206S": "Parcela 29",
    "0961201XH8206S": "Parcela 39",
    "0961202XH8206S": "Parcela 38",
    "0961203XH8206S": "Parcela 37",
    "0961204XH8206S": "Parcela 36",
    "0961205XH8206S": "Parcela 35",
    "0961701XH8206S": "Parcela 2",
    "0961703XH8206S": "Parcela 5",
    "0961704XH8206S": "Parcela 4",
    "0961705XH8206S": "Parcela 3",
    "0961801XH8206S": "Parcela 6",
    "0961802XH8206S": "Parcela 7",
    "0961803XH8206S": "Parcela 8",
    "0961804XH8206S": "Parcela 9",
    "0961805XH8206S": "Parcela 10",
    "0961806XH8206S": "Parcela 11",
    "0961807XH8206S": "Parcela 12",
    "0961808XH8206S": "Parcela 13",
    "0961809XH8206S": "Parcela 21",
    "0961810XH8206S": "Parcela 20",
    "0961811XH8206S": "Parcela 19",
    "0961812XH8206S": "Parcela 18",
    "0961813XH8206S": "Parcela 17",
    "0961814XH8206S": "Parcela 16",
    "0961815XH8206S": "Parcela 15",
    "0961816XH8206S": "Parcela 14",
    "2980903XH9225S": "Calle Joseph Ortin 10",
    "6233606XH9263S": "Calle Comadrona Maria Dolore",
    "5932706XH9253S": "Sector 3, Parcela 10.2",
}

# --- geometry --------------------------------------------------------------------------------

GRS80_A = 6378137.0
GRS80_F = 1.0 / 298.257222101
UTM_K0 = 0.9996
UTM_ZONE = 30
UTM_FALSE_EASTING = 500000.0
EARTH_RADIUS_M = 6371000.0
METRES_PER_DEGREE = 111320.0
COORD_DECIMALS = 6
COORD_SCALE = 1000000
MORTON_SHIFT_DEG = 200

# --- search and map ----------------------------------------------------------------------------

RESULT_LIMIT = 8
RENDER_CAP = 1500
BOUNDS_PAD = 0.2
ZOOM_THRESHOLD = 14
LOW_ACCURACY_M = 30.0

# --- roads -------------------------------------------------------------------------------------

SPEED_KMH = {
    "motorway": 100,
    "trunk": 90,
    "primary": 80,
    "secondary": 70,
    "tertiary": 60,
    "unclassified": 45,
    "residential": 40,
    "living_street": 20,
    "service": 30,
    "track": 20,
    "road": 40,
    "motorway_link": 60,
    "trunk_link": 50,
    "primary_link": 50,
    "secondary_link": 40,
    "tertiary_link": 40,
}
FOOT_LIKE = ["footway", "path", "cycleway", "pedestrian", "bridleway", "steps", "corridor"]
FOOT_LIKE_SPEED = 20
ACCESS_TAGS = ["motor_vehicle", "motorcar", "vehicle", "access"]
ACCESS_POSITIVE = ["yes", "permissive", "destination", "designated", "delivery", "customers"]
ACCESS_NEGATIVE = ["no", "private", "agricultural", "forestry", "agricultural;forestry", "military"]
ONEWAY_FORWARD = ["yes", "true", "1"]
ONEWAY_REVERSE = ["-1", "reverse"]
ONEWAY_NONE = ["no", "false", "0"]
ROUNDABOUT = ["roundabout", "circular"]
BAN_TYPES = [
    "no_left_turn",
    "no_right_turn",
    "no_straight_on",
    "no_u_turn",
    "no_entry",
    "no_exit",
]
ONLY_TYPES = ["only_left_turn", "only_right_turn", "only_straight_on"]
EXCEPT_VEHICLES = ["motorcar", "motor_vehicle", "vehicle", "delivery"]
GRAPH_MARGIN_DEG = 0.02
MAP_MARGIN_DEG = 0.05
MAX_TILE_DEG = 0.12
ATTRIBUTION = "(c) OpenStreetMap contributors"
LICENSE = "ODbL 1.0"

# --- routing and guidance --------------------------------------------------------------------------

SNAP_CELL_DEG = 0.003
SNAP_CAP_M = 500.0
REVERSAL_PENALTY_CS = 9000
REVERSAL_MIN_DEG = 150.0
TURN_MIN_DEG = 25.0
TURN_SLIGHT_MAX_DEG = 60.0
TURN_NORMAL_MAX_DEG = 120.0
JUNCTION_MIN_DEGREE = 3
OFF_ROUTE_M = 35.0
OFF_ROUTE_FIXES = 2
ARRIVE_M = 30.0
HEADING_MIN_SPEED_MS = 1.5
HEADING_MIN_MOVE_M = 8.0
ETA_FACTOR = 1.4
ETA_TURN_S = 10
MANEUVER_TEXT = {
    "depart": "Comienza la ruta",
    "straight": "Continúa recto",
    "slight-left": "Gira ligeramente a la izquierda",
    "slight-right": "Gira ligeramente a la derecha",
    "left": "Gira a la izquierda",
    "right": "Gira a la derecha",
    "sharp-left": "Gira bruscamente a la izquierda",
    "sharp-right": "Gira bruscamente a la derecha",
    "arrive": "Has llegado",
}
MANEUVER_DEFAULT = "Continúa"
