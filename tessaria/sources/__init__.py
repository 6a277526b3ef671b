"""tessaria.sources"""
