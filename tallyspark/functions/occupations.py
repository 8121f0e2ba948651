"""Occupations whose tips may be deducted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The Treasury's tipped occupation codes with their titles, from the public list of the Internal Revenue Service.
OCCUPATIONS = (
    ("101", "Bartenders"),
    ("102", "Wait staff"),
    ("103", "Food or beverage servers, non-restaurant"),
    ("104", "Dining room and cafeteria attendants and bartender helpers"),
    ("105", "Chefs and cooks"),
    ("106", "Food preparation workers"),
    ("107", "Fast food and counter workers"),
    ("108", "Dishwashers"),
    ("109", "Host staff, restaurant, lounge, and coffee shop"),
    ("110", "Bakers"),
    ("201", "Gambling dealers"),
    ("202", "Gambling change persons and booth cashiers"),
    ("203", "Gambling cage workers"),
    ("204", "Gambling and sports book writers and runners"),
    ("205", "Dancers"),
    ("206", "Musicians and singers"),
    ("207", "Disc jockeys, except radio"),
    ("208", "Entertainers and performers"),
    ("209", "Digital content creators"),
    ("210", "Ushers, lobby attendants, and ticket takers"),
    ("211", "Locker room, coatroom, and dressing room attendants"),
    ("301", "Baggage porters and bellhops"),
    ("302", "Concierges"),
    ("303", "Hotel, motel, and resort desk clerks"),
    ("304", "Maids and housekeeping cleaners"),
    ("401", "Home maintenance and repair workers"),
    ("402", "Home landscaping and groundskeeping workers"),
    ("403", "Home electricians"),
    ("404", "Home plumbers"),
    ("405", "Home heating and air conditioning mechanics and installers"),
    ("406", "Home appliance installers and repairers"),
    ("407", "Home cleaning service workers"),
    ("408", "Locksmiths"),
    ("409", "Roadside assistance workers"),
    ("501", "Personal care and service workers"),
    ("502", "Private event planners"),
    ("503", "Private event and portrait photographers"),
    ("504", "Private event videographers"),
    ("505", "Event officiants"),
    ("506", "Pet and show animal caretakers"),
    ("507", "Tutors"),
    ("508", "Nannies and babysitters"),
    ("509", "Visual artists"),
    ("510", "Floral designers"),
    ("601", "Skincare specialists"),
    ("602", "Massage therapists"),
    ("603", "Barbers, hairdressers, hairstylists, and cosmetologists"),
    ("604", "Shampooers"),
    ("605", "Manicurists and pedicurists"),
    ("606", "Eyebrow and eyelash technicians"),
    ("607", "Makeup artists"),
    ("608", "Exercise trainers and group fitness instructors"),
    ("609", "Tattoo artists and piercers"),
    ("610", "Tailors"),
    ("611", "Shoe and leather workers and repairers"),
    ("701", "Golf caddies"),
    ("702", "Self-enrichment teachers"),
    ("703", "Recreational and tour pilots"),
    ("704", "Tour guides"),
    ("705", "Travel guides"),
    ("706", "Sports and recreation instructors"),
    ("801", "Parking and valet attendants"),
    ("802", "Taxi and rideshare drivers and chauffeurs"),
    ("803", "Shuttle drivers"),
    ("804", "Goods delivery people"),
    ("805", "Personal vehicle and equipment cleaners"),
    ("806", "Private and charter bus drivers"),
    ("807", "Water taxi operators and charter boat workers"),
    ("808", "Rickshaw, pedicab, and carriage drivers"),
    ("809", "Home movers"),
    ("810", "Gas pump Attendant"),
)


def occupations(spark: SparkSession) -> DataFrame:
    """The list as a dimension table (code, title)."""
    return spark.createDataFrame(list(OCCUPATIONS), "code string, title string")
