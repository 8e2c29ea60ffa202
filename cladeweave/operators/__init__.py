"""DataFrame operators: curation, alignment sites, distances, concatenation, trees."""
