"""See the package README section on layout."""
