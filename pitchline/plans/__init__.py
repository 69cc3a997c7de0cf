"""What a user calls: ratings, translation, stability and shot analyses."""
