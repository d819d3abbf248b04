"""airlattice: PySpark-native analytics for radio-mesh sites, terrain, links and receptions."""
