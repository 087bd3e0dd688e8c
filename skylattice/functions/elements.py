"""What the codes of data elements in schedule files mean."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# The codes of the schedule format and their official descriptions.
DESCRIPTIONS = {
    1: "Joint Operation Airline Designators",
    2: "Operating Airline Disclosure — Code Share",
    3: "Aircraft Owner",
    4: "Cockpit Crew Employer",
    5: "Cabin Crew Employer",
    6: "Onward Flight",
    7: "Meal Service Note",
    8: "Traffic Restriction Note",
    9: "Operating Airline Disclosure — Shared Airline or Wet Lease",
    10: "Duplicate Leg Cross Reference — Duplicate Leg Identification",
    11: "Partnership Specification",
    50: "Duplicate Leg Cross Reference — Operational Leg Identification",
    97: "UTC/Local Time Variation Specification",
    98: "Passenger Terminal Identifier — Arrival",
    99: "Passenger Terminal Identifier — Departure",
    101: "Passenger Reservations Booking Designator Segment Override",
    102: "Passenger Reservations Booking Modifier Segment Override",
    104: "Blocked Seats and/or Unit Load Devices",
    105: "Restricted Payload",
    106: "PRBD Exceeding Maximum Length",
    107: "PRBM Exceeding Maximum Length",
    108: "Aircraft Configuration/Version Exceeding Maximum Length",
    109: "Meal Service Note Exceeding Maximum Length",
    111: "Meal Service Segment Override",
    113: "Aircraft Owner Specification",
    114: "Cockpit Crew Employer Specification",
    115: "Cabin Crew Employer Specification",
    121: "Aircraft Type Publication Override",
    122: "Flight Number Override",
    125: "Joint Operation Airline Designators Segment Override",
    127: "Operating Airline Disclosure",
    170: "Traffic Restriction Code — Passengers Only",
    171: "Traffic Restriction Code — Cargo/Mail Only",
    172: "Traffic Restriction Code — Cargo Only",
    173: "Traffic Restriction Code — Mail Only",
    198: "Passenger Terminal Segment Override — Arrival",
    199: "Passenger Terminal Segment Override — Departure",
    201: "Subject to Government Approval",
    210: "Plane Change without Aircraft Type Change",
    220: "MCT International/Domestic Status Override",
    299: "Passenger Check-In",
    301: "Flaglanding at Off Point Only",
    302: "Flaglanding at Off Point and Board Point",
    303: "Flaglanding at Board Point Only",
    501: "On-Time Performance Indicator",
    502: "On-Time Performance Indicator for Delays & Cancellations",
    503: "In-Flight Service Information",
    504: "Secure Flight Indicator",
    505: "Electronic Ticketing Information",
    507: "Request All Reservations",
    710: "Traffic Restriction Code Qualifier at Board Point",
    711: "Traffic Restriction Code Qualifier at Off Point",
    712: "Traffic Restriction Code Qualifier at Board and Off Points",
}
RANGES = {
    (713, 799): "Traffic Restriction Code Information — Free Format",
    (800, 899): "Data Element Identifiers — Free Format Bilateral Use",
    (900, 999): "Data Element Identifiers — Free Format Internal Use",
}
UNKNOWN = "Unknown DEI"


def description(code: Column) -> Column:
    """The description of a code given as a number or as a text of digits; what is none is unknown."""
    n = code.try_cast("int")
    out = F.try_element_at(F.create_map(*map(F.lit, chain.from_iterable(DESCRIPTIONS.items()))), n)
    for (first, last), text in RANGES.items():
        out = F.when(n.between(first, last), text).otherwise(out)
    return F.coalesce(out, F.lit(UNKNOWN))
