"""Reading, staging and writing of collections and graphs."""
