"""The facade, results, plot data and registered queries."""
